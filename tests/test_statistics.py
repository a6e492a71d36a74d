import datetime as dt
import os
import random

import duckdb
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import statistics as S
from tidemark.operators import cells as C
from tidemark.plans import suites

catalog.load()


def test_ranges_give_the_same_values(spark):
    rng = random.Random(9)
    p = [rng.random() ** 3 for _ in range(2000)] + [0.25] * 300 + [1.0] * 200 + [0.0] * 3 + [None] * 4
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i long, p double")
    for some in (df, df.where("i < 1"), df.where("p is null"), df.where("i < 0")):
        want = {r["i"]: r["q"] for r in S.benjamini_hochberg(some).collect()}
        assert {r["i"]: r["q"] for r in S.benjamini_hochberg_ranges(some).collect()} == want


def test_ranges_within_groups(spark):
    """One group holds most rows and is split over the ranges; a null group is a group."""
    rng = random.Random(11)
    rows = [(i, "big" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([None, 1.0, 1.0, round(rng.random() ** 3, 3)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, f string, p double")
    for some in (df, df.where("i < 5"), df.where("i < 0")):
        want = {r["i"]: r["q"] for r in S.benjamini_hochberg(some, by=["f"]).collect()}
        found = S.benjamini_hochberg_ranges(some, by=["f"])
        assert found.columns == ["i", "f", "p", "q"] and {r["i"]: r["q"] for r in found.collect()} == want


def test_the_suite_holds_fifteen_families(spark):
    from tidemark.plans import mechanisms as M

    d = "/root/testdata/sf0.01"
    rows = M.suite_rows(M.points(spark, d), M.S.markets(spark, d), M.fill_returns(spark, d))
    per = {r["family_id"]: (r["n"], r["matched"]) for r in rows.groupBy("family_id").agg(F.count("*").alias("n"), F.count("incremental").alias("matched")).collect()}
    assert len(per) == 15
    assert {f for f, (n, m) in per.items() if m == 0} == {"close", "listing", "maker"} and all(m in (0, n) for n, m in per.values())


def test_no_task_ranks_the_whole_table(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    plan = suites.false_discovery(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "row_number" not in plan


@pytest.fixture(scope="module")
def fractions(spark, tmp_path_factory):
    """The smallest tables with events half a second beside the edges of staleness bins and of the listing."""
    given, d = "/root/testdata/sf0.001", tmp_path_factory.mktemp("fractions")
    for f in os.listdir(given):
        if f != "events.parquet":
            (d / f).symlink_to(f"{given}/{f}")
    rows = []
    for user in range(3, 700):
        start, end = dt.datetime(2024, 1, 1) + dt.timedelta(days=user % 10), dt.datetime(2024, 1, 31) - dt.timedelta(days=user % 7)
        before, share = ((3600, 0.02), (3600, 0.1), (3600, 0.2), (86400, 0.1), (7 * 86400, 0.2))[user // 14 % 5]
        rows.append((len(rows), user, end - dt.timedelta(seconds=before * (1 + share) + (0.5 if user % 2 else -0.5)), "view", user / 7))
        rows.append((len(rows), user, start - dt.timedelta(seconds=0.5), "click", user / 3))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
    (d / "events.parquet").rename(d / "rows")
    next((d / "rows").glob("*.parquet")).rename(d / "events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["x14_family_periods", "x14_suite_correction", "x26_rebuild"])
def test_fractions_of_a_second_count_as_in_sql(spark, fractions, name):
    assert difference(catalog.QUERIES[name](spark, fractions), connect(fractions), catalog.ORACLES[name]) is None


def test_halves_are_rounded_as_in_sql(spark):
    values = [3013.56375, -3013.56375, 1.00005, 2.5, 0.12345, 0.00005, 1e300, None, float("nan")] + [i + k / 1e5 for i in range(300) for k in (5, 15, 12345)]
    want = duckdb.connect().execute("select round(v, 4) from (select unnest(?::double[]) as v)", [values]).fetchall()
    got = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(S.sql_round(F.col("v"), 4)).collect()
    assert [repr(r[0]) for r in got] == [repr(r[0]) for r in want]


def test_a_mean_that_is_zero_but_for_its_sum_has_not_passed(spark):
    rows = [("f", "c", "early", i, 1.0, x) for i, x in enumerate((1e-16, 2e-17, 5e-17, 6e-17, 7e-17, 8e-17))]
    df = spark.createDataFrame(rows, "family_id string, cell_id string, period string, event_ticker int, ann double, incremental double")
    assert [C.evaluate_cells(df, "ann", 5, 0.0, 1.0, incremental="incremental", digits=n)[1].first()["all_pass"] for n in (None, 12)] == [True, False]
