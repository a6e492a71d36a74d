"""Queries of forecast calibration, recalibration and their returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import panel as P
from tidemark.operators.tables import pick
from tidemark.sources import tables as S

# Forecasts and observations from events: the station is the user modulo 20, the lead is the user modulo 3.
FORECASTS = """forecasts as (select event_id, user_id % 20 as station, user_id % 2 as weather_stat, user_id % 3 as lead_days, cast(ts as date) as target_date, value as forecast_f, ts as available_at from events where event_type in ('view', 'click', 'signup')),
 observations as (select user_id % 20 as station, user_id % 2 as weather_stat, cast(ts as date) as target_date, avg(value) as observed_f, max(ts) + interval 1 day as available_at from events where event_type in ('purchase', 'error') group by all)"""


def forecasts(spark, d):
    e = S.table(spark, d, "events").where(F.col("event_type").isin("view", "click", "signup"))
    u = F.col("user_id")
    return e.select("event_id", F.pmod(u, F.lit(20)).alias("station"), F.pmod(u, F.lit(2)).alias("weather_stat"), F.pmod(u, F.lit(3)).alias("lead_days"), F.to_date("ts").alias("target_date"), F.col("value").alias("forecast_f"), F.col("ts").alias("available_at"))


def observations(spark, d):
    e = S.table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    u = F.col("user_id")
    return e.groupBy(F.pmod(u, F.lit(20)).alias("station"), F.pmod(u, F.lit(2)).alias("weather_stat"), F.to_date("ts").alias("target_date")).agg(F.avg("value").alias("observed_f"), (F.max("ts") + F.expr("interval 1 day")).alias("available_at"))


DAILY = """err as (select f.station, f.weather_stat, f.lead_days, f.target_date, o.observed_f - f.forecast_f as e, o.available_at as known from forecasts f join observations o using (station, weather_stat, target_date)),
 daily as (select station, weather_stat, lead_days, target_date, count(*) as n, sum(e) as s, sum(e * e) as q, max(known) as known from err group by all),
 cum as (select station, weather_stat, lead_days, known, sum(n) over w as n, sum(s) over w as s, sum(q) over w as q from daily window w as (partition by station, weather_stat, lead_days order by known rows unbounded preceding))"""


@query(
    "w12_rolling_calibration",
    f"""with {FORECASTS}, {DAILY} select f.event_id, case when c.n >= 30 then cast(c.n as bigint) end as calibration_n, round(case when c.n >= 30 then c.s / c.n end, 5) as bias, round(case when c.n >= 30 then sqrt(greatest(2.25, (c.q - c.s * c.s / c.n) / (c.n - 1))) end, 4) as sigma
    from forecasts f asof left join cum c on f.station = c.station and f.weather_stat = c.weather_stat and f.lead_days = c.lead_days and f.available_at >= c.known""",
)
def rolling_calibration(spark, d):
    c = P.rolling_calibration(forecasts(spark, d), observations(spark, d), least=30)
    return c.select("event_id", "calibration_n", F.round("calibration_bias_f", 5).alias("bias"), F.round("calibration_sigma_f", 4).alias("sigma"))


@query(
    "j14_latest_available",
    f"""with {FORECASTS} select o.station, o.weather_stat, cast(o.target_date as varchar) as target_date, f.event_id from observations o join forecasts f using (station, weather_stat, target_date) where f.available_at <= o.available_at - interval 36 hour
    qualify row_number() over (partition by o.station, o.weather_stat, o.target_date order by f.available_at desc, f.lead_days desc, f.event_id desc) = 1""",
)
def latest_available(spark, d):
    o = observations(spark, d).select("station", "weather_stat", "target_date", F.col("available_at").alias("decided"))
    j = o.join(forecasts(spark, d), ["station", "weather_stat", "target_date"]).where(F.col("available_at") <= F.col("decided") - F.expr("interval 36 hours"))
    keys = ["station", "weather_stat", "target_date"]
    return pick(j, keys, [F.desc("available_at"), F.desc("lead_days"), F.desc("event_id")]).select("station", "weather_stat", F.col("target_date").cast("string").alias("target_date"), "event_id")


EDGES = P.RECALIBRATION_EDGES
BIN = "(case " + " ".join(f"when p < {e} then {i}" for i, e in enumerate(EDGES[1:-1])) + f" else {len(EDGES) - 2} end)"
SCORED = """scored as (select l_partkey, l_orderkey % 3 as fold, pow((l_quantity - 1) / 49.0, 3) as p, case when l_discount > 0.04 then 1 else 0 end as y from lineitem)"""


def scored(spark, d):
    li = S.table(spark, d, "lineitem")
    return li.select("l_partkey", F.pmod("l_orderkey", F.lit(3)).alias("fold"), F.pow((F.col("l_quantity") - 1) / 49.0, F.lit(3)).alias("p"), F.when(F.col("l_discount") > 0.04, 1).otherwise(0).alias("y"))


TABLE = f"""bins as (select fold, {BIN} as bin, count(*) as n, sum(y) as hits from scored group by all), spine as (select fold, bin from (select distinct fold from scored), (select unnest(range({len(EDGES) - 1})) as bin)),
 tab as (select s.fold, s.bin, coalesce(n, 0) as n, coalesce(max((hits + 0.5) / (n + 1.0)) over (partition by s.fold order by s.bin rows unbounded preceding), 0) as calibrated from spine s left join bins b on b.fold = s.fold and b.bin = s.bin)"""


@query("a30_recalibration", f"with {SCORED}, {TABLE} select fold, bin, n, round(calibrated, 6) as calibrated from tab")
def recalibration(spark, d):
    return P.recalibration_table(scored(spark, d), "p", "y", ["fold"]).select("fold", "bin", "n", F.round("calibrated", 6).alias("calibrated"))


@query(
    "a31_walk_forward",
    f"""with {SCORED}, src as (select f.fold, s.p, s.y from (values (0, 0), (1, 0), (2, 0), (2, 1)) f(fold, source) join scored s on s.fold = f.source), bins as (select fold, {BIN} as bin, count(*) as n, sum(y) as hits from src group by all),
    spine as (select fold, bin from (select distinct fold from src), (select unnest(range({len(EDGES) - 1})) as bin)), tab as (select s.fold, s.bin, coalesce(max((hits + 0.5) / (n + 1.0)) over (partition by s.fold order by s.bin rows unbounded preceding), 0) as calibrated from spine s left join bins b on b.fold = s.fold and b.bin = s.bin)
    select s.fold, s.fold = 0 as in_fit, count(*) as n, round(avg(pow(calibrated - y, 2)), 6) as brier_calibrated, round(avg(pow(s.p - y, 2)), 6) as brier_raw from (select *, {BIN} as bin from scored) s join tab using (fold, bin) group by all""",
)
def walk_forward(spark, d):
    s = scored(spark, d)
    sources = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).cast("long").alias("to")) for a, b in ((0, 0), (0, 1), (0, 2), (1, 2))])
    past = s.withColumn("_m", F.explode(F.filter(sources, lambda m: m["source"] == F.col("fold")))).select(F.col("_m.to").alias("fold"), "p", "y")
    cal = P.apply_recalibration(s, P.recalibration_table(past, "p", "y", ["fold"]), "p", ["fold"])
    return cal.groupBy("fold", (F.col("fold") == 0).alias("in_fit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("calibrated") - F.col("y"), 2)), 6).alias("brier_calibrated"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier_raw"))


@query("a27_brier", f"with {SCORED} select fold, count(*) as n, round(avg(pow(p - y, 2)), 6) as model, round(avg(pow(0.6 - y, 2)), 6) as market from scored group by fold")
def brier(spark, d):
    return scored(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("model"), F.round(F.avg(F.pow(0.6 - F.col("y"), 2)), 6).alias("market"))


@query("a29_bands", f"with {SCORED} select case when p <= 0.02 then 'tail' when p <= 0.5 then 'low' else 'high' end as band, count(*) as n, count(distinct l_partkey) as parts, round(avg(p), 6) as implied, round(avg(y), 6) as realised from scored group by 1")
def bands(spark, d):
    from tidemark.functions.labels import right_closed

    return scored(spark, d).groupBy(right_closed(F.col("p"), (0.02, 0.5), ("tail", "low", "high")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.avg("p"), 6).alias("implied"), F.round(F.avg("y"), 6).alias("realised"))


@query(
    "x22_threshold_families",
    f"""with {SCORED} select threshold, side, fold, count(*) as n, round(avg(case when side = 'yes' then y else 1 - y end), 6) as win from (select *, abs(p - 0.6) * 100 as edge, case when p > 0.6 then 'yes' else 'no' end as side from scored) join (values (5), (20), (40)) t(threshold) on edge >= threshold group by all""",
)
def thresholds(spark, d):
    s = scored(spark, d).withColumns({"edge": F.abs(F.col("p") - 0.6) * 100, "side": F.when(F.col("p") > 0.6, "yes").otherwise("no")})
    each = s.withColumn("threshold", F.explode(F.filter(F.array(F.lit(5), F.lit(20), F.lit(40)), lambda t: F.col("edge") >= t)))
    return each.groupBy("threshold", "side", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("side") == "yes", F.col("y")).otherwise(1 - F.col("y"))), 6).alias("win"))
