import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dominance import dominance_sums
from tidemark.operators.panel import paper_fills

AT = dt.datetime(2026, 1, 1)


def rows(seed, n, hot):
    """(id, key, time, level, value): a hot key holds a third, few distinct times, so ties abound."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        out.append((i, key, rng.choice([None, *[AT + dt.timedelta(minutes=m) for m in range(60)]]), rng.choice([None, -3, 0, 100, 140, *range(1, 99, 7)]), rng.choice([None, 1, 2, 5])))
    return out


def brute(points, tape):
    clip = lambda v, low: max(low, min(100, v))
    return {
        i: 0 if None in (k, t, v) else sum(w for _, k2, t2, v2, w in tape if k2 == k and t2 is not None and t2 >= t and None not in (v2, w) and clip(v2, 0) <= clip(v, -1))
        for i, k, t, v, _ in points
    }


@pytest.mark.parametrize("parts", ["1", "7"])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_sums_against_brute_force(spark, parts, kind, monkeypatch):
    points, tape = rows(1, 400, 0.4), rows(2, 900, 0.5)
    schema = f"id int, key string, ts timestamp_ntz, level int, value {kind}"
    number = float if kind == "double" else int
    make = lambda rs: spark.createDataFrame([(*r[:4], None if r[4] is None else number(r[4])) for r in rs], schema)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        p = make(points).withColumn("_sum", F.lit("clash"))
        got = dominance_sums(p, make(tape), ["key"], "ts", "ts", F.col("level"), F.col("level"), F.col("value"), "found")
        assert got.columns == [*p.columns, "found"]
        assert {r["id"]: r["found"] for r in got.collect()} == brute(points, tape)
        assert dominance_sums(p.limit(0), make(tape), ["key"], "ts", "ts", F.col("level"), F.col("level"), F.col("value"), "found").count() == 0
        assert {r["found"] for r in dominance_sums(p, make(tape).limit(0), ["key"], "ts", "ts", F.col("level"), F.col("level"), F.col("value"), "found").collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_ticker_is_split_and_every_row_moves_once(spark):
    """All rows of one ticker: ranges are even, and the plan has one exchange of the rows and no pairs."""
    n = 40_000
    tape = spark.range(n).select(F.lit("T").alias("ticker"), (F.lit(AT).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).alias("created_time"), (F.col("id") % 99 + 1).alias("yes_price_cents"), F.lit(1).cast("long").alias("count"), F.lit("yes").alias("taker_side"))
    orders = tape.select(F.monotonically_increasing_id().alias("order_id"), "ticker", (100 - F.col("yes_price_cents")).alias("price_c"), F.col("created_time").alias("placed_ts"), F.lit(n).cast("long").alias("qty"))
    got = paper_fills(orders, tape, share=1.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Repartition" not in plan  # swept rows and their ends, no tape
    filled = sorted(got.select("placed_ts", "price_c", "filled_qty").collect())
    seen = [0] * 101
    for placed, price, q in reversed(filled):
        seen[100 - price] += 1
        assert q == sum(seen[: 100 - price + 1])
