import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.functions import statistics as S
from tidemark.functions import text as T
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.operators import tables as O
from tidemark.operators.asof import asof_join


def t(day, hour=0, month=1):
    return dt.datetime(2026, month, day, hour)


def one(spark, column, kinds, *values):
    return spark.createDataFrame([values], kinds).select(column).first()[0]


MARKET = "ticker string, event_ticker string, series_ticker string, category string, fee_type string, open_time timestamp_ntz, close_time timestamp_ntz, expiration_time timestamp_ntz, settled_time timestamp_ntz, can_close_early boolean, result string, volume double"
TAPE = "ticker string, trade_id string, created_time timestamp_ntz, yes_price_cents long, count double, taker_side string, is_block_trade boolean"


def market(spark, ticker="M1", close=t(10), opened=t(1), **kw):
    row = dict(ticker=ticker, event_ticker="EV1", series_ticker="S1", category="Politics", fee_type="quadratic", open_time=opened, close_time=close, expiration_time=close, settled_time=close, can_close_early=False, result="no", volume=100.0) | kw
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in MARKET.split(", "))], MARKET)


def test_fees_and_buckets(spark):
    df = spark.createDataFrame([(p,) for p in (1, 3, 5, 10, 50, 95, 99)], "p long")
    got = df.select("p", E.taker_fee(F.col("p")).alias("t"), E.maker_fee(F.col("p"), F.lit(E.MAKER_FEES)).alias("m"), L.screen_bucket(F.col("p")).alias("a"), L.suite_bucket(F.col("p")).alias("b")).collect()
    for r in got:
        assert r["t"] == math.ceil(7 * r["p"] * (100 - r["p"]) / 10000) and r["m"] == math.ceil(7 * r["p"] * (100 - r["p"]) / 40000)
    labels = {r["p"]: (r["a"], r["b"]) for r in got}
    assert labels[5] == ("05-10", "01-05") and labels[1][0] == "01-5" and labels[99] == ("95-99", "96-99")


def test_move_bins_keep_their_gaps(spark):
    bins = ((-9, -3), (-2, 2), (3, 9))
    df = spark.createDataFrame([(float(x),) for x in (-3, 2, 9, 0, 2.5)], "x double")
    assert [r[0] for r in df.select(L.fixed_bin(F.col("x"), bins)).collect()] == ["out", "out", "out", "-2:2", "out"]


def test_asof_point_and_flow(spark):
    tape = spark.createDataFrame([("M1", "a", t(8), 10, 3.0, "yes", False), ("M1", "b", t(9, 12), 80, 7.0, "no", False)], TAPE)
    got = P.build_decision_points(market(spark), tape, (("close", "T-1d", 86400),)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["yes_price_cents"], r["trade_time"], r["cumulative_volume"], r["volume_24h"]) == (10, t(8), 3.0, 0.0)


def test_two_labels_at_one_instant_give_two_rows(spark):
    tape = spark.createDataFrame([("M1", "a", t(8), 10, 3.0, "yes", False)], TAPE)
    m = market(spark, opened=t(8))
    got = P.build_decision_points(m, tape, (("close", "T-1d", 86400), ("open", "O+1d", 86400))).collect()
    assert sorted(r["decision_label"] for r in got) == ["O+1d", "T-1d"]


def test_snapshot(spark):
    tape = spark.createDataFrame([("M1", "a", dt.datetime(2025, 12, 31), 80, 5.0, "yes", False), ("M1", "b", t(8), 95, 5.0, "yes", False)], TAPE)
    r = P.build_snapshots(market(spark, opened=dt.datetime(2025, 12, 1)), tape, (7,)).collect()
    assert len(r) == 1 and (r[0]["yes_price_cents"], r[0]["staleness_s"], r[0]["cum_volume"], r[0]["hold_days"]) == (80, 3 * 86400, 5.0, 7)
    late = spark.createDataFrame([("M1", "b", t(8), 95, 5.0, "yes", False)], TAPE)
    assert P.build_snapshots(market(spark), late, (7,)).count() == 0


def test_asof_ties_nulls_and_clashing_names(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), (None, 5, 3), ("b", None, 4)], "k string, ts int, v int")
    right = spark.createDataFrame([("a", 5, 2, 20), ("a", 5, 1, 10), ("a", None, 1, 30), (None, 1, 1, 40)], "k string, rts int, tie int, v int")
    got = {r["v"]: r["r_v"] for r in asof_join(left, right, ["k"], "ts", "rts", ["tie"], prefix="r_").collect()}
    assert got == {1: 20, 2: None, 3: None, 4: None}


def test_clustered_error(spark):
    df = spark.createDataFrame([("a", "e1", 1.0), ("a", "e1", 2.0), ("a", "e2", 5.0), ("a", "e3", 8.0)], "cell string, event_ticker string, x double")
    r = C.cell_stats(df, ["cell"], ["x"]).first()
    assert (r["n"], r["n_events"], r["x_mean"]) == (4, 3, 4.0) and abs(r["x_se"] - math.sqrt(42) / 4) < 1e-12
    single = spark.createDataFrame([(str(i), float(i)) for i in (1, 2, 3, 4)], "event_ticker string, x double")
    assert abs(C.cell_stats(single, [], ["x"]).first()["x_se"] - math.sqrt(5) / 4) < 1e-12


def test_false_discovery(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.9,)], "p double")
    assert sorted(round(r["q"], 6) for r in S.benjamini_hochberg(df).collect()) == [0.004, 0.04, 0.04, 0.9]


def test_normal_tails(spark):
    df = spark.createDataFrame([(x / 7,) for x in range(-40, 60)], "x double")
    assert all(abs(r[1] - math.erfc(r[0])) <= 2e-7 * math.erfc(r[0]) for r in df.select("x", S.erfc(F.col("x"))).collect())
    kinds = "k string, lo double, hi double, m double, s double"
    prob = S.bracket_probability(*[F.col(c) for c in ("k", "lo", "hi", "m", "s")])
    assert abs(one(spark, prob, kinds, "greater", 70.0, None, 70.5, 1.0) - 0.5) < 1e-6
    assert abs(one(spark, prob, kinds, "between", 70.0, 71.0, 70.5, 1.0) - 0.6826895) < 1e-6
    assert one(spark, prob, kinds, "less", None, 71.0, 70.5, 0.0) is None


def test_within_group_residuals(spark):
    rows = [("a", 30, 1.0), ("a", 90, 3.0), ("b", 30, 10.0), ("b", 90, 12.0), ("c", 30, 9.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double")
    got = {(r["g"], r["h"]): r["r"] for r in C.demean_spanning(df, ["g"], "x", "h", "r").collect()}
    assert got == {("a", 30): -1.0, ("a", 90): 1.0, ("b", 30): -1.0, ("b", 90): 1.0}


POINT = "ticker string, event_ticker string, decision_label string, decision_time timestamp_ntz, trade_time timestamp_ntz, yes_price_cents long"


def test_paths_need_a_new_trade_and_siblings_leave_themselves_out(spark):
    rows = [("A", "E", "T-7d", t(1), t(1), 10), ("A", "E", "T-1d", t(5), t(4), 20), ("B", "E", "T-7d", t(1), t(1), 30), ("B", "E", "T-1d", t(5), t(4), 25), ("C", "F", "T-7d", t(1), t(1), 5), ("C", "F", "T-1d", t(5), t(1), 5)]
    df = spark.createDataFrame(rows, POINT)
    assert {r["ticker"] for r in P.path_rows(df, [("T-7d", "T-1d")]).collect()} == {"A", "B"}
    assert {r["ticker"]: r["sibling_move_cents"] for r in P.sibling_rows(df, [("T-7d", "T-1d")]).collect()} == {"A": -5.0, "B": 10.0}


def test_shocks(spark):
    rows = [("M", f"{i:03d}", dt.datetime(2026, 1, 1, i), 3, 10.0, "yes", False) for i in range(10)]
    rows += [("M", "a", dt.datetime(2026, 1, 1, 10, 1), 5, 100.0, "yes", False), ("M", "b", dt.datetime(2026, 1, 1, 10, 2), 5, 150.0, "yes", False), ("M", "c", dt.datetime(2026, 1, 1, 10, 3), 5, 50.0, "no", False), ("M", "d", dt.datetime(2026, 1, 1, 11), 8, 500.0, "yes", False)]
    f = P.shock_features(P.bars(spark.createDataFrame(rows, TAPE)))
    got = P.select_shocks(f).collect()
    assert len(got) == 1 and (got[0]["shock_price"], got[0]["yes_volume"], got[0]["signal_ts"]) == (5, 250.0, dt.datetime(2026, 1, 1, 11))
    moved = [r[:2] + (r[2] + dt.timedelta(days=3) if r[2].hour >= 10 else r[2],) + r[3:] for r in rows[:-1]]
    assert P.select_shocks(P.shock_features(P.bars(spark.createDataFrame(moved, TAPE)))).count() == 0
    quiet = P.bars(spark.createDataFrame([("M", "a", t(1), 5, 3.0, "no", False)], TAPE)).first()
    assert quiet["yes_volume"] == 0.0 and quiet["yes_close"] is None


def test_forward_changes(spark):
    s = spark.createDataFrame([("A", t(2), 5), ("B", t(2), 5)], "ticker string, signal_ts timestamp_ntz, shock_price long")
    tape = spark.createDataFrame([("A", "x", t(1, 23), 9, 1.0, "yes", False), ("A", "y", t(2, 20), 3, 1.0, "yes", False)], TAPE)
    got = {r["ticker"]: r for r in P.forward_changes(s, tape, (24,)).collect()}
    assert (got["A"]["change_24h"], got["B"]["change_24h"], got["B"]["change_24h_zero"]) == (-2, None, 0)


def test_ladder_and_coherence(spark):
    rows = [("a", "E1", "above", 10.0, 30), ("b", "E1", "above", 20.0, 40), ("c", "E2", "below", 10.0, 40), ("d", "E2", "below", 20.0, 30)]
    df = spark.createDataFrame([(k, e, "T-1d", t(9), t(8), d, s, p) for k, e, d, s, p in rows], "ticker string, event_ticker string, decision_label string, decision_time timestamp_ntz, trade_time timestamp_ntz, direction string, floor_strike double, yes_price_cents long")
    assert [(r["signed_gap_cents"], r["pair_cost_cents"]) for r in P.ladder_pairs(df).collect()] == [(10, 90), (10, 90)]
    legs = [("E", t(9), dt.datetime(2026, 1, 8, 0, m), p) for m, p in ((0, 40), (3, 35), (7, 30))]
    frame = spark.createDataFrame([(e, "T-1d", d, tt, p, True, 3) for e, d, tt, p in legs], "event_ticker string, decision_label string, decision_time timestamp_ntz, trade_time timestamp_ntz, yes_price_cents long, is_exclusive_group boolean, expected_contracts int")
    r = P.event_coherence(frame).first()
    assert (r["yes_price_sum_cents"], r["dislocation_cents"], r["dislocation_side"], r["trade_time_skew_seconds"]) == (105, 5, "buy_all_no", 420)
    assert P.event_coherence(frame.limit(2)).count() == 0


def test_paper_fills(spark):
    orders = spark.createDataFrame([(1, "M", 95, 10, t(1))], "order_id int, ticker string, price_c int, qty int, placed_ts timestamp_ntz")
    prints = spark.createDataFrame([("M", "a", t(2), 5, 4.0, "yes", False), ("M", "b", t(2), 5, 8.0, "no", False)], TAPE)
    assert P.paper_fills(orders, prints).select("filled_qty", "state").first() == (2, "partial")
    assert P.paper_fills(orders, prints.where("taker_side = 'no'")).select("filled_qty", "state").first() == (0, "resting")


def test_recalibration(spark):
    rows = [(0.15, int(i < 2)) for i in range(100)] + [(0.001, 0)] * 200
    table = P.recalibration_table(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    v = [r["calibrated"] for r in table.orderBy("bin").collect()]
    assert v == sorted(v) and 0.015 < v[6] < 0.035 and v[7] == v[14] == v[6] and len(v) == 15
    probe = spark.createDataFrame([(None,), (1.0,)], "p double")
    assert [r["calibrated"] for r in P.apply_recalibration(probe, table, "p").collect()] == [None, v[6]]


def test_calibration_never_sees_the_future(spark):
    kinds = "station string, weather_stat string, target_date date, lead_days int, forecast_f double, available_at timestamp_ntz"
    f = spark.createDataFrame([("a", "max", dt.date(2026, 1, i), 1, 50.0, t(i)) for i in range(1, 6)], kinds)
    o = spark.createDataFrame([("a", "max", dt.date(2026, 1, i), 60.0, t(i + 2)) for i in range(1, 6)], "station string, weather_stat string, target_date date, observed_f double, available_at timestamp_ntz")
    got = {r["target_date"].day: (r["calibration_n"], r["calibration_bias_f"]) for r in P.rolling_calibration(f, o, least=1).collect()}
    assert got[2] == (None, None) and got[3] == (1, 10.0) and got[5] == (3, 10.0)


def test_text_classes(spark):
    kinds = "e string, t string"
    sig = T.mention_signal(F.col("e"), F.col("t"))
    assert one(spark, sig, kinds, "Ann Lee", "text Ann B. Lee here") == "WARM"
    assert one(spark, sig, kinds, "Ann Lee", "Ann Lee. CLOTURE motions: Lee") == "HOT"
    assert one(spark, sig, kinds, "Ann Lee", "no one of note") == "CLEAR"
    assert one(spark, sig, kinds, "Ann Lee", "Mr. Lee spoke") == "CLEAR"
    assert one(spark, sig, kinds, "Ann Lee", "and then Lee spoke") == "UNKNOWN"
    assert one(spark, sig, kinds, None, "x") == "UNKNOWN"
    assert one(spark, T.target_date(F.col("e")), kinds, "KX-26FEB30", "") is None
    assert one(spark, T.target_date(F.col("e")), kinds, "KX-26FEB03", "") == dt.date(2026, 2, 3)
    assert one(spark, T.station_temperature(F.col("e")), kinds, "+0261,1", "") == pytest.approx(78.98)
    assert one(spark, T.station_temperature(F.col("e")), kinds, "+9999,9", "") is None
    assert one(spark, T.rule_class(F.col("e"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("t")), kinds, "deemed so", "no") == "judgment_or_attribution"
    tier = T.tier(F.lit("A"), F.lit("Politics"), F.col("e"), F.array(F.col("t")), exceptions=("nba youngboy",))
    assert one(spark, tier, kinds, "A methodical title", "x") == "deployment"
    assert one(spark, tier, kinds, "Who wins the NBA", "x") == "instrumentation"
    assert one(spark, tier, kinds, "NBA YoungBoy album", "x") == "deployment"


def test_dedupe_and_sets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert {r["k"]: r["v"] for r in O.latest(df, "k", F.col("v")).collect()} == {"a": 2, "b": 3, None: 4}
    assert {r["v"] for r in O.excluding(df, df.where("k = 'a'"), "k").collect()} == {3, 4}
    assert {r["v"] for r in O.pick(df, ["k"], [F.col("v")]).collect()} == {1, 3, 4}


def test_shock_gate_needs_every_metric_in_both_periods(spark):
    from tidemark.plans.composites import shock_gate

    schema = "period string, n long, ret_no_mean double, ret_no_se double, uplift_mean double, uplift_se double"
    good = {p: [p, 200, 0.30, 0.05, 0.20, 0.05] for p in ("discovery", "confirmation")}

    def verdict(rows):
        return tuple(shock_gate(spark.createDataFrame(rows, schema), 30, 0.07).first())

    assert verdict(list(good.values())) == ("GREEN", "")
    assert verdict([good["discovery"], ["confirmation", 200, 0.30, 0.05, 0.05, 0.04]]) == ("RED", "confirmation: uplift")
    assert verdict([good["discovery"], ["confirmation", 200, 0.30, 0.05, None, None]]) == ("RED", "confirmation: uplift")
    assert verdict([good["discovery"], ["confirmation", 200, None, 0.05, 0.2, 0.05]]) == ("RED", "confirmation: return")
    assert verdict([good["discovery"]]) == ("RED", "confirmation: support")
    assert verdict([]) == ("RED", "confirmation: support; discovery: support")


def test_asof_reads_each_side_once(spark, tmp_path):
    """Rows and carry come from one exchange; nulls in keys and times match nothing, days are bridged."""
    from tidemark.operators.asof import trailing_sums

    at = dt.datetime(2026, 1, 1)
    tape = [("a", at, 1, "x"), ("a", at + dt.timedelta(days=3), 2, "y"), (None, at, 7, "z"), ("b", None, 7, "z"), ("b", at + dt.timedelta(hours=1), 4, "w")]
    points = [(1, "a", at + dt.timedelta(days=2)), (2, "a", at + dt.timedelta(days=9)), (3, None, at + dt.timedelta(days=2)), (4, "b", None), (5, "b", at), (6, "b", at + dt.timedelta(hours=2))]
    spark.createDataFrame(tape, "k string, rts timestamp_ntz, v long, note string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame(points, "id int, k string, ts timestamp_ntz").write.parquet(str(tmp_path / "l"))
    left, right = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    joined = asof_join(left, right, ["k"], "ts", "rts", ["v"], running={"total": F.col("v")})
    flow = trailing_sums(left, right, ["k"], "ts", "rts", 48, {"flow": F.col("v")})
    assert {r["id"]: (r["v"], r["total"]) for r in joined.collect()} == {1: (1, 1), 2: (2, 3), 3: (None, None), 4: (None, None), 5: (None, None), 6: (4, 4)}
    assert {r["id"]: r["flow"] for r in flow.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 4}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (joined.select("id", "v", "total"), flow.select("id", "flow")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 2 and plan.count("ReusedExchange") == 1, plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
