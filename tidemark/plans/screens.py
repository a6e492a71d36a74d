"""Queries of cell statistics, screens, coverage, maps and health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.operators import cells as C
from tidemark.operators.panel import build_snapshots
from tidemark.plans.labels import FEE, TAKER, edges_sql, period_sql
from tidemark.plans.panels import HORIZONS, SNAPSHOTS
from tidemark.sources import tables as S


def P():
    return F.col("yes_price_cents")


def Y():
    return F.col("result_yes")


def stats_sql(source: str, keys: str, values: list[str], cluster: str = "event_ticker", digits: int = 6) -> str:
    """Cell statistics by the definition: residual sums of the clusters around the cell's mean."""
    k = keys
    join = " and ".join(f"x.{c.strip()} is not distinct from m.{c.strip()}" for c in k.split(",")) if k else "true"
    out = []
    for v in values:
        out.append(f"round(max(m.{v}_mean), {digits}) as {v}_mean, round(sqrt(sum(pow(x.s_{v} - x.n_{v} * m.{v}_mean, 2))) / max(m.n_{v}), {digits}) as {v}_se")
    means = ", ".join(f"avg({v}) as {v}_mean, count({v}) as n_{v}" for v in values)
    sums = ", ".join(f"coalesce(sum({v}), 0) as s_{v}, count({v}) as n_{v}" for v in values)
    ks = ", ".join(f"m.{c.strip()}" for c in k.split(",")) if k else ""
    head = f"{ks}, " if k else ""
    lead = f"{k}, " if k else ""
    return f"""select {head}max(m.n) as n, count(*) as n_events, {', '.join(out)} from (select {lead}{cluster}, {sums} from {source} group by {lead}{cluster}) x
    join (select {lead}count(*) as n, {means} from {source} {'group by ' + k if k else ''}) m on {join} {'group by ' + ks if k else ''}"""


def rounded(df, digits=6):
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


FILL_RETURNS = f"""fr as (select *, horizon_days as h, (100.0 * (1 - result_yes) - (100 - yes_price_cents) - {FEE}) / (100 - yes_price_cents) as maker, (100.0 * (1 - result_yes) - (100 - yes_price_cents) - {TAKER}) / (100 - yes_price_cents) as taker,
 {edges_sql('yes_price_cents')} as bucket, case when horizon_days < 7 then 'a 1-7d' when horizon_days < 30 then 'b 7-30d' when horizon_days < 90 then 'c 30-90d' when horizon_days < 180 then 'd 90-180d' else 'e 180d+' end as band from fills)"""


def fill_returns(spark, d):
    df = S.fills(spark, d)
    maker = E.no_return(P(), Y(), E.maker_fee(P(), F.col("fee_type")))
    return df.withColumns({"maker": maker, "taker": E.no_return(P(), Y(), E.taker_fee(P())), "bucket": L.screen_bucket(P()), "band": L.horizon_band(F.col("horizon_days"))})


@query("a01_cell_stats", f"with {S.FILLS}, {FILL_RETURNS} {stats_sql('fr', 'category, band', ['maker'])}")
def cell_stats(spark, d):
    return rounded(C.cell_stats(fill_returns(spark, d), ["category", "band"], ["maker"]))


@query("a02_cluster_se", f"with {S.FILLS}, {FILL_RETURNS} {stats_sql('fr', '', ['maker', 'taker'])}")
def cluster_se(spark, d):
    return rounded(C.cell_stats(fill_returns(spark, d), [], ["maker", "taker"]))


@query("x08_maker_taker", f"with {S.FILLS}, {FILL_RETURNS}, g as (select *, maker - taker as gap from fr) {stats_sql('g', 'period, band, bucket', ['maker', 'taker', 'gap'])}")
def maker_taker(spark, d):
    df = fill_returns(spark, d).withColumn("gap", F.col("maker") - F.col("taker"))
    return rounded(C.cell_stats(df, ["period", "band", "bucket"], ["maker", "taker", "gap"]))


SNAP = f"""snap as (select s.ticker, s.event_ticker, s.series_ticker, s.category, s.fee_type, s.horizon_days, t.yes_price_cents, case when s.result = 'yes' then 1 else 0 end as result_yes,
 cast(date_diff('second', s.snap_ts, coalesce(s.settled_time, s.close_time)) // 86400 as bigint) as hold_days, s.snap_ts from snapshots s asof join tape t on s.ticker = t.ticker and s.snap_ts >= t.created_time),
 sr as (select *, (100.0 * (1 - result_yes) - (100 - yes_price_cents) - {FEE}) / (100 - yes_price_cents) as ret_no, {edges_sql('yes_price_cents')} as bucket, {period_sql('snap_ts + to_days(cast(hold_days as integer))', S.SPLIT)} as period from snap where hold_days >= 1),
 sa as (select *, (ret_no + 0.0325 * hold_days / 365.0) * 365.0 / hold_days as ann_no from sr)"""


def snapshot_returns(spark, d):
    s = build_snapshots(S.markets(spark, d), S.trades(spark, d), HORIZONS).where("hold_days >= 1")
    ret = E.no_return(P(), Y(), E.maker_fee(P(), F.col("fee_type")))
    end = F.col("snap_ts") + F.make_dt_interval(F.col("hold_days").cast("int"))
    s = s.withColumns({"ret_no": ret, "bucket": L.screen_bucket(P()), "period": L.period(end, S.SPLIT)})
    return s.withColumn("ann_no", E.annualised(F.col("ret_no"), F.col("hold_days")))


@query("x06_calibration", f"with {S.TRADES}, {S.MARKETS}, {SNAPSHOTS}, {SNAP}, c as (select *, yes_price_cents / 100.0 as implied, result_yes as realised from sa) {stats_sql('c', 'period, horizon_days, bucket', ['implied', 'realised', 'ret_no'], digits=4)}")
def calibration(spark, d):
    df = snapshot_returns(spark, d).withColumns({"implied": P() / 100.0, "realised": Y()})
    return rounded(C.cell_stats(df, ["period", "horizon_days", "bucket"], ["implied", "realised", "ret_no"]), 4)


@query("x07_term_premium", f"with {S.TRADES}, {S.MARKETS}, {SNAPSHOTS}, {SNAP} {stats_sql('sa', 'category, horizon_days', ['ann_no'])}")
def term_premium(spark, d):
    return rounded(C.cell_stats(snapshot_returns(spark, d), ["category", "horizon_days"], ["ann_no"]))


@query(
    "w07_within_market",
    f"""with {S.TRADES}, {S.MARKETS}, {SNAPSHOTS}, {SNAP}, r as (select *, ann_no - avg(ann_no) over w as resid from sa window w as (partition by ticker) qualify min(horizon_days) over w <> max(horizon_days) over w)
    {stats_sql('r', 'horizon_days', ['resid'])}""",
)
def within_market(spark, d):
    return rounded(C.cell_stats(C.demean_spanning(snapshot_returns(spark, d), ["ticker"], "ann_no", "horizon_days", "resid"), ["horizon_days"], ["resid"]))


@query("a09_support_table", f"with {S.FILLS} select category, count(*) filter (horizon_days < 30) as short, count(*) filter (horizon_days between 30 and 179) as middle, count(*) filter (horizon_days >= 180) as long from fills group by category")
def support_table(spark, d):
    h = F.col("horizon_days")
    kind = F.when(h < 30, "short").when(h < 180, "middle").otherwise("long")
    return S.fills(spark, d).withColumn("k", kind).groupBy("category").pivot("k", ["short", "middle", "long"]).count()


@query("a11_top_share", f"with {S.FILLS}, c as (select category, event_ticker, count(*) as n, row_number() over (partition by category order by count(*) desc, event_ticker) as r from fills group by category, event_ticker) select category, round(sum(case when r <= 10 then n else 0 end) * 1.0 / sum(n), 6) as top_share from c group by category")
def top_share(spark, d):
    return rounded(C.top_share(S.fills(spark, d), ["category"]))


FAMILY = """fam as (select category, ticker % 50 as series_ticker, count(*) as n, count(distinct event_ticker) as n_events, count(distinct ticker) as n_markets, avg(yes_price_cents) / 100 as implied, avg(result_yes) as tail_rate,
 count(distinct case when result_yes = 1 then event_ticker end) as firing_events from fills where yes_price_cents <= 15 group by all)"""


@query(
    "x10_family_base_rates",
    f"""with {S.FILLS}, b as (select *, ticker % 50 as series_ticker from fills where yes_price_cents <= 15), {FAMILY}, st as ({stats_sql('b', 'category, series_ticker', ['result_yes'], digits=12)}),
    q as (select f.*, st.result_yes_se as tail_se, least(1, greatest(0, case when tail_rate = 0 then 3.0 / f.n_events else tail_rate + 1.96 * st.result_yes_se end)) as q_hi from fam f join st using (category, series_ticker))
    select category, series_ticker, n, n_events, n_markets, firing_events, round(implied, 9) as implied, round(tail_rate, 9) as tail_rate, round(q_hi, 5) as q_hi,
    case when tail_rate >= implied and firing_events >= 2 then 'TRAP' when n_events < 8 or (tail_rate = 0 and q_hi > 2 * implied) then 'THIN' else 'NEUTRAL' end as label from q""",
)
def family_base_rates(spark, d):
    df = S.fills(spark, d).where(P() <= 15).withColumn("series_ticker", F.pmod("ticker", F.lit(50)))
    keys = ["category", "series_ticker"]
    s = C.cell_stats(df, keys, ["result_yes"])
    more = df.groupBy(*keys).agg(F.count_distinct("ticker").alias("n_markets"), (F.avg(P()) / 100).alias("implied"), F.count_distinct(F.when(Y() == 1, F.col("event_ticker"))).alias("firing_events"))
    j = s.join(more, keys).withColumnsRenamed({"result_yes_mean": "tail_rate", "result_yes_se": "tail_se"})
    hi = F.when(F.col("tail_rate") == 0, 3.0 / F.col("n_events")).otherwise(F.col("tail_rate") + 1.96 * F.col("tail_se"))
    j = j.withColumn("q_hi", F.least(F.lit(1.0), F.greatest(F.lit(0.0), hi)))
    label = F.when((F.col("tail_rate") >= F.col("implied")) & (F.col("firing_events") >= 2), "TRAP").when((F.col("n_events") < 8) | ((F.col("tail_rate") == 0) & (F.col("q_hi") > 2 * F.col("implied"))), "THIN").otherwise("NEUTRAL")
    return j.select(*keys, "n", "n_events", "n_markets", "firing_events", F.round("implied", 9).alias("implied"), F.round("tail_rate", 9).alias("tail_rate"), F.round("q_hi", 5).alias("q_hi"), label.alias("label"))


@query("a06_persistence", f"with {S.FILLS} select category, period, count(*) as n, count(distinct event_ticker) as events, round(avg(yes_price_cents) / 100, 6) as implied, round(avg(result_yes), 6) as rate from fills where category in (select category from fills group by category having avg(result_yes) > 0.29) group by all")
def persistence(spark, d):
    f = S.fills(spark, d)
    keep = f.groupBy("category").agg(F.avg(Y()).alias("r")).where("r > 0.29")
    df = f.join(keep, "category", "left_semi")
    return rounded(df.groupBy("category", "period").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"), (F.avg(P()) / 100).alias("implied"), F.avg(Y()).alias("rate")))


@query(
    "x05_corpus_audit",
    f"""with {S.TRADES}, {S.MARKETS}, t as (select distinct ticker from trades where yes_price_cents > 60) select count(*) as markets, count(distinct event_ticker) as events, count(distinct series_ticker) as series,
    count(*) filter (ticker in (select ticker from t)) as with_tape, count(*) filter (settled_time is null) as missing_settled, count(*) filter (can_close_early and settled_time is null) as early_without_resolution,
    count(*) filter (close_time > timestamp '2024-01-28') as future_end, count(*) filter (volume >= 60 and date_diff('day', open_time, close_time) < 20) as traded_short from markets""",
)
def corpus_audit(spark, d):
    tape = S.trades(spark, d).where(P() > 60).select("ticker").distinct().withColumn("has_tape", F.lit(True))
    m = S.markets(spark, d).join(tape, "ticker", "left")
    life = F.timestamp_diff("DAY", F.col("open_time"), F.col("close_time"))
    return m.agg(
        F.count(F.lit(1)).alias("markets"), F.count_distinct("event_ticker").alias("events"), F.count_distinct("series_ticker").alias("series"), F.count("has_tape").alias("with_tape"),
        F.count_if(F.col("settled_time").isNull()).alias("missing_settled"), F.count_if(F.col("can_close_early") & F.col("settled_time").isNull()).alias("early_without_resolution"),
        F.count_if(F.col("close_time") > F.lit("2024-01-28").cast("timestamp_ntz")).alias("future_end"), F.count_if((F.col("volume") >= 60) & (life < 20)).alias("traded_short"),
    )


@query(
    "a08_coverage",
    f"with {S.FILLS} select category, year(created_time) as year, count(*) as fills, count(distinct event_ticker) as events, sum(count) as contracts, count(*) filter (count >= 25) as over_25, round(avg(case when count >= 40 then 1.0 else 0 end), 6) as share_40 from fills group by all",
)
def coverage(spark, d):
    c = F.col("count")
    return rounded(S.fills(spark, d).groupBy("category", F.year("created_time").alias("year")).agg(F.count(F.lit(1)).alias("fills"), F.count_distinct("event_ticker").alias("events"), F.sum("count").alias("contracts"), F.count_if(c >= 25).alias("over_25"), F.avg((c >= 40).cast("double")).alias("share_40")))


LEVELS = [("fine", ["category", "bucket", "band"]), ("merged", ["category", "band"]), ("pooled", ["bucket"])]


def _level(name, keys, source, rest):
    k = ", ".join(keys)
    on = " and ".join(f"r.{c} = w.{c}" for c in keys)
    return f"""{name}_s as ({stats_sql(source, k + ', period', ['maker'], digits=9)}),
    {name}_w as (select {k}, max(n) filter (period = 'discovery') as dn, max(n) filter (period = 'confirmation') as cn, max(maker_mean) filter (period = 'discovery') as dm, max(maker_se) filter (period = 'confirmation') as cs from {name}_s group by {k} having coalesce(dn, 0) >= 60 and coalesce(cn, 0) >= 60),
    {rest} as (select r.* from {source} r where not exists (select 1 from {name}_w w where {on}))"""


@query(
    "x09_pooling_cascade",
    f"""with {S.FILLS}, {FILL_RETURNS}, {_level('fine', LEVELS[0][1], 'fr', 'r1')}, {_level('merged', LEVELS[1][1], 'r1', 'r2')}, {_level('pooled', LEVELS[2][1], 'r2', 'r3')}
    select 'fine' as level, category, bucket, band, dn, cn, round(dm, 6) as dm, round(cs, 6) as cs, null as leftover_n from fine_w union all by name select 'merged' as level, category, band, dn, cn, round(dm, 6) as dm, round(cs, 6) as cs from merged_w
    union all by name select 'pooled' as level, bucket, dn, cn, round(dm, 6) as dm, round(cs, 6) as cs from pooled_w union all by name select 'insufficient' as level, category, bucket, band, count(*) as leftover_n from r3 group by all""",
)
def pooling(spark, d):
    out = C.pooling_cascade(fill_returns(spark, d), LEVELS, "maker", 60)
    six = lambda c: F.round(F.round(c, 9), 6)  # noqa: E731  statistics have nine digits, the map shows six of them
    return out.select("level", "category", "bucket", "band", F.col("discovery_n").alias("dn"), F.col("confirmation_n").alias("cn"), six("discovery_maker_mean").alias("dm"), six("confirmation_maker_se").alias("cs"), "leftover_n")


@query(
    "x11_edge_health",
    f"""with {S.FILLS}, {FILL_RETURNS}, g as (select fr.*, w.win from fr, (values (90), (365)) w(win) where created_time >= timestamp '1998-12-01' - to_days(cast(w.win as integer)) and yes_price_cents between 1 and 20), s as ({stats_sql('g', 'win, category', ['maker'], digits=9)})
    select win as days, category, n, n_events, round(maker_mean, 6) as maker_mean, case when n < 30 or maker_mean is null then 'THIN' when maker_mean - maker_se < 0.0325 then 'RED' when maker_mean - maker_se < 0.07 then 'AMBER' else 'GREEN' end as light from s""",
)
def edge_health(spark, d):
    now = F.lit("1998-12-01").cast("timestamp_ntz")
    df = fill_returns(spark, d).where(P().between(1, 20)).withColumn("days", F.explode(F.array(F.lit(90), F.lit(365)))).where(F.col("created_time") >= now - F.make_dt_interval(F.col("days")))
    s = C.cell_stats(df, ["days", "category"], ["maker"])
    return s.select("days", "category", "n", "n_events", F.round("maker_mean", 6).alias("maker_mean"), E.health_light(F.col("maker_mean"), F.col("maker_se"), F.col("n")).alias("light"))


@query(
    "a26_quarterly_trend",
    f"""with {S.FILLS}, {FILL_RETURNS}, q as (select year(created_time) || 'Q' || quarter(created_time) as quarter, count(*) as n, round(avg(maker), 6) as mean from fr group by 1 having count(*) >= 10 order by quarter desc limit 8) select * from q""",
)
def quarterly(spark, d):
    t = F.col("created_time")
    q = fill_returns(spark, d).groupBy(F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("maker"), 6).alias("mean"))
    return q.where("n >= 10").orderBy(F.desc("quarter")).limit(8)


@query("a24_distribution", f"with {S.FILLS}, {FILL_RETURNS} select category, round(avg(maker), 6) as mean, round(median(maker), 6) as median, round(quantile_cont(maker, 0.1), 6) as p10, round(quantile_cont(maker, 0.9), 6) as p90, round(avg(case when maker < 0 then 1.0 else 0 end), 6) as share_down from fr group by category")
def distribution(spark, d):
    m = F.col("maker")
    return rounded(fill_returns(spark, d).groupBy("category").agg(F.avg(m).alias("mean"), F.median(m).alias("median"), F.percentile(m, 0.1).alias("p10"), F.percentile(m, 0.9).alias("p90"), F.avg((m < 0).cast("double")).alias("share_down")))


@query("a24_nearest_quantile", f"with {S.FILLS}, {FILL_RETURNS}, r as (select category, maker, row_number() over (partition by category order by maker) as r, count(*) over (partition by category) as n from fr) select category, round(maker, 6) as p10 from r where r = cast(floor((n - 1) * 0.1 + 0.5) as bigint) + 1")
def nearest_quantile(spark, d):
    w = Window.partitionBy("category")
    df = fill_returns(spark, d).select("category", "maker").withColumns({"r": F.row_number().over(w.orderBy("maker")), "n": F.count(F.lit(1)).over(w)})
    return df.where(F.col("r") == F.floor((F.col("n") - 1) * 0.1 + 0.5) + 1).select("category", F.round("maker", 6).alias("p10"))


@query(
    "a34_book_rollup",
    """select round(sum(case when o_orderstatus in ('P', 'F') then o_totalprice else 0 end), 2) as deployed, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2) as resting, count(*) filter (o_orderstatus = 'P') as partial_orders, count(*) as n_orders from orders""",
)
def book_rollup(spark, d):
    o = S.table(spark, d, "orders")
    st, v = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.agg(F.round(F.sum(F.when(st.isin("P", "F"), v).otherwise(0)), 2).alias("deployed"), F.round(F.sum(F.when(st == "O", v).otherwise(0)), 2).alias("resting"), F.count_if(st == "P").alias("partial_orders"), F.count(F.lit(1)).alias("n_orders"))
