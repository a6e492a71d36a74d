"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import catalog

DATA = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "x01_snapshots", "x02_decision_points", "x04_relations", "x06_calibration", "x07_term_premium", "w07_within_market", "x08_maker_taker", "x09_pooling_cascade", "x10_family_base_rates",
    "x11_edge_health", "x12_flow_shocks", "x13_structural_atlas", "x14_family_periods", "x17_ladder_summary", "x18_event_coherence", "x24_paper_orders", "a01_cell_stats", "a10_hourly_bars",
    "a13_a16_search_correction", "a30_recalibration", "j10_trailing_flow", "j12_asof_features", "w03_rolling_median", "w05_sibling_moves", "w12_rolling_calibration",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run has compiled code
            began = time.time()
            catalog.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": DATA.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
