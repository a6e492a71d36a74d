"""Composite pipelines: flow-shock screen with its gate, rule objectivity, forecast panels and families, search funnel and the rebuild order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.functions import text as T
from tidemark.functions.statistics import erfc_sql, normal_cdf
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.operators.tables import pick
from tidemark.plans.forecasts import DAILY, FORECASTS, forecasts, observations
from tidemark.plans.labels import ranges_sql
from tidemark.plans.panels import BARS, BLOCKLESS, POINTS, RULE, SHOCKS, points, shaped
from tidemark.plans.screens import FILL_RETURNS, fill_returns, rounded, stats_sql
from tidemark.plans.suites import SIDES, side_panel
from tidemark.sources import tables as S
from tidemark.sources.staging import written


def registry_filter(spec: dict) -> Column:
    """A predicate from a registered filter: column -> list (in), or a dict of in, not_in, min, max; ``staleness_fraction``
    bounds staleness by the scheduled hold; ``trustworthy`` asks for a decision time known in advance."""
    out = F.lit(True)
    for name, rule in spec.items():
        if name == "staleness_fraction":
            out = out & (F.col("staleness_seconds") <= rule * F.col("scheduled_hold_seconds"))
        elif name == "trustworthy":
            out = out & (F.col("decision_time_trustworthy") if rule else F.lit(True))
        else:
            rule = {"in": rule} if isinstance(rule, (list, tuple)) else rule
            c = F.col(name)
            if "in" in rule:
                out = out & c.isin(*rule["in"])
            if "not_in" in rule:
                out = out & ~c.isin(*rule["not_in"])
            if "min" in rule:
                out = out & (c >= rule["min"])
            if "max" in rule:
                out = out & (c <= rule["max"])
    return out


SPEC = {"category": [0, 1, 2], "yes_price_cents": {"min": 5, "max": 60}, "series_ticker": {"not_in": [3]}, "staleness_fraction": 0.5, "trustworthy": True}


@query(
    "p08_registry_filter",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS} select ticker, label as decision_label from points where category in (0, 1, 2) and yes_price_cents between 5 and 60 and series_ticker <> 3
    and date_diff('microsecond', trade_time, decision_time) // 1000000 <= 0.5 * date_diff('second', decision_time, close_time) and (anchor = 'open' or not can_close_early)""",
)
def filtered(spark, d):
    return points(spark, d).where(registry_filter(SPEC)).select("ticker", "decision_label")


def shock_screen(shocks: DataFrame, bars: DataFrame, markets: DataFrame, split) -> DataFrame:
    """Shocks with settlement return, matched controls (first bars of tickers without a shock in the same price bucket) and uplift."""
    m = markets.select("ticker", "event_ticker", "fee_type", (F.col("result") == "yes").cast("int").alias("result_yes"))

    def returns(df, price):
        p = F.col(price)
        df = df.join(m, "ticker").withColumn("bucket", L.flow_bucket(p))
        return df.withColumn("ret_no", E.no_return(p, F.col("result_yes"), E.maker_fee(p, F.col("fee_type"))))

    hit = returns(shocks, "shock_price").withColumn("period", L.period(F.col("signal_ts"), split))
    first = bars.where("yes_close is not null").groupBy("ticker").agg(F.min_by("yes_close", "hour").alias("control_price"))
    controls = returns(first.join(shocks.select("ticker"), "ticker", "left_anti"), "control_price")
    base = controls.groupBy("bucket").agg(F.avg("ret_no").alias("baseline"))
    return hit.join(base, "bucket", "left").withColumn("uplift", F.col("ret_no") - F.col("baseline"))


def shock_gate(stats: DataFrame, least: int, hurdle: float, periods=("discovery", "confirmation")) -> DataFrame:
    """GREEN if every period has the support and clears return and uplift at two errors, else RED with the reasons.

    What is unknown has not passed: a null statistic fails its test, and a period
    without a row fails for want of support.
    """
    def fails(passed):
        return ~F.coalesce(passed, F.lit(False))

    wanted = stats.sparkSession.createDataFrame([(p,) for p in periods], "period string")
    seen = wanted.join(stats, "period", "left")
    known = F.col("n").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(fails(F.col("n") >= least), F.concat("period", F.lit(": support"))),
            F.when(known & fails(F.col("ret_no_mean") - 2 * F.col("ret_no_se") > hurdle), F.concat("period", F.lit(": return"))),
            F.when(known & fails(F.col("uplift_mean") - 2 * F.col("uplift_se") > 0), F.concat("period", F.lit(": uplift"))),
        )
    )
    one = seen.select(F.explode_outer(reasons).alias("r"))
    listed = F.array_sort(F.collect_list("r"))
    return one.agg(F.when(F.size(listed) == 0, "GREEN").otherwise("RED").alias("verdict"), F.array_join(listed, "; ").alias("reasons"))


SCREEN = f"""hit as (select s.ticker, s.shock_price as p, m.event_ticker, m.fee_type, case when m.result = 'yes' then 1 else 0 end as y, case when s.signal_ts < timestamp '2024-01-16' then 'discovery' else 'confirmation' end as period from shocks s join markets m using (ticker)),
 ctl as (select arg_min(yes_close, hour) as p, b.ticker from bars b where yes_close is not null and ticker not in (select ticker from shocks) group by b.ticker),
 both_ as (select ticker, p, event_ticker, fee_type, y, period, 1 as is_hit from hit union all select c.ticker, p, event_ticker, fee_type, case when result = 'yes' then 1 else 0 end, null, 0 from ctl c join markets m using (ticker)),
 ret as (select *, case when p < 5 then '01-5' when p < 10 then '05-10' else '10-20' end as bucket, (100.0 * (1 - y) - (100 - p) - case when fee_type = 'quadratic_with_maker_fees' then (7 * p * (100 - p) + 39999) // 40000 else 0 end) / (100 - p) as ret_no from both_),
 up as (select r.*, ret_no - b.base as uplift from ret r left join (select bucket, avg(ret_no) as base from ret where is_hit = 0 group by 1) b on r.bucket = b.bucket where is_hit = 1)"""


@query("a22_shock_summary", f"with {BLOCKLESS}, {S.MARKETS}, {BARS}, {SHOCKS}, {SCREEN} {stats_sql('up', 'period', ['ret_no', 'uplift'])}")
def shock_summary(spark, d):
    f = shaped(spark, d)
    s = shock_screen(P.select_shocks(f, **RULE), f, S.markets(spark, d), S.SPLIT)
    return rounded(C.cell_stats(s, ["period"], ["ret_no", "uplift"]))


def category_breakdown(screen: DataFrame, least_events: int) -> DataFrame:
    """Support and means of a shock screen by period and category; rows without uplift and thin cells are left out."""
    cells = screen.where("uplift is not null").groupBy("period", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"), F.round(F.avg("shock_price"), 2).alias("shock_price"), F.round(F.avg("ret_no"), 3).alias("ret_no"),
        F.round(F.avg("uplift"), 3).alias("uplift"), F.round(F.avg("result_yes"), 4).alias("tail_rate"),
    )
    return cells.where(F.col("events") >= least_events)


@query(
    "a23_category_breakdown",
    f"""with {BLOCKLESS}, {S.MARKETS}, {BARS}, {SHOCKS}, {SCREEN} select period, ticker % 5 as category, count(*) as n, count(distinct event_ticker) as events, round(avg(p), 2) as shock_price, round(avg(ret_no), 3) as ret_no, round(avg(uplift), 3) as uplift, round(avg(y), 4) as tail_rate
    from up where uplift is not null group by 1, 2 having count(distinct event_ticker) >= 2""",
)
def categories(spark, d):
    f, m = shaped(spark, d), S.markets(spark, d)
    s = shock_screen(P.select_shocks(f, **RULE), f, m, S.SPLIT).join(m.select("ticker", "category"), "ticker")
    return category_breakdown(s, 2)


@query(
    "e17_shock_gate",
    f"""with {BLOCKLESS}, {S.MARKETS}, {BARS}, {SHOCKS}, {SCREEN}, st as ({stats_sql('up', 'period', ['ret_no', 'uplift'], digits=12)}),
    r as (select unnest(list_filter([case when n < 30 then period || ': support' end, case when not coalesce(ret_no_mean - 2 * ret_no_se > 0.07, false) then period || ': return' end, case when not coalesce(uplift_mean - 2 * uplift_se > 0, false) then period || ': uplift' end], lambda x: x is not null)) as r from st)
    select case when count(r) = 0 then 'GREEN' else 'RED' end as verdict, coalesce(string_agg(r, '; ' order by r), '') as reasons from r""",
)
def gate(spark, d):
    f = shaped(spark, d)
    s = shock_screen(P.select_shocks(f, **RULE), f, S.markets(spark, d), S.SPLIT)
    return shock_gate(C.cell_stats(s, ["period"], ["ret_no", "uplift"]), 30, E.HURDLE)


@query(
    "e15_family_labels",
    f"""with {S.FILLS}, {FILL_RETURNS}, b as (select *, ticker % 40 as series_ticker from fr where yes_price_cents <= 40), st as ({stats_sql('b', 'series_ticker', ['result_yes', 'maker'], digits=12)}),
    f as (select series_ticker, avg(yes_price_cents) / 100 as implied, count(distinct case when result_yes = 1 then event_ticker end) as firing from b group by 1),
    q as (select *, least(1, greatest(0, case when result_yes_mean = 0 then 3.0 / n_events else result_yes_mean + 1.96 * result_yes_se end)) as q_hi from st join f using (series_ticker))
    select series_ticker, case when result_yes_mean >= implied and firing >= 2 then 'TRAP' when n_events < 8 or (result_yes_mean = 0 and q_hi > 2 * implied) then 'THIN' when n >= 50 and maker_mean - 2 * maker_se > 0.07 and q_hi < implied then 'FAT' else 'NEUTRAL' end as label from q""",
)
def family_labels(spark, d):
    df = fill_returns(spark, d).where("yes_price_cents <= 40").withColumn("series_ticker", F.pmod("ticker", F.lit(40)))
    more = df.groupBy("series_ticker").agg((F.avg("yes_price_cents") / 100).alias("implied"), F.count_distinct(F.when(F.col("result_yes") == 1, F.col("event_ticker"))).alias("firing"))
    s = C.cell_stats(df, ["series_ticker"], ["result_yes", "maker"]).join(more, "series_ticker")
    rate = F.col("result_yes_mean")
    hi = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(rate == 0, 3.0 / F.col("n_events")).otherwise(rate + 1.96 * F.col("result_yes_se"))))
    fat = (F.col("n") >= 50) & (F.col("maker_mean") - 2 * F.col("maker_se") > E.HURDLE) & (hi < F.col("implied"))
    label = F.when((rate >= F.col("implied")) & (F.col("firing") >= 2), "TRAP").when((F.col("n_events") < 8) | ((rate == 0) & (hi > 2 * F.col("implied"))), "THIN").when(F.coalesce(fat, F.lit(False)), "FAT").otherwise("NEUTRAL")
    return s.select("series_ticker", label.alias("label"))


RULES = """rules as (select ticker, case when ticker % 4 = 0 then 'as deemed by' when ticker % 4 = 1 then 'signed into law' when ticker % 4 = 2 then 'the price is 5' else 'else' end as rules,
 case ticker % 4 when 0 then 'judgment_or_attribution' when 1 then 'official_act' when 2 then 'numeric_objective' else 'unclassified' end as rule_class from markets)"""

RULE_CELLS = f"select rule_class || '|' || e.label || '|' || {ranges_sql('yes_price_cents')} || '|' || side as cell_id, period, event_ticker, ann, ann - avg(ann) over (partition by category, e.label, {ranges_sql('yes_price_cents')}, side) as incremental from econ e join rules using (ticker)"


def rule_rows(panel: DataFrame, classes: DataFrame) -> DataFrame:
    """Both sides of the panel in the cells of their rules' class. The baseline leaves the period out on purpose, unlike that of the other families."""
    r = panel.join(classes, "ticker").withColumn("bucket", L.suite_bucket(F.col("yes_price_cents")))
    r = C.residualise(r, ["category", "decision_label", "bucket", "side"], "ann", "incremental")
    return r.select(L.cell_key(F.col("rule_class"), F.col("decision_label"), F.col("bucket"), F.col("side")).alias("cell_id"), "period", "event_ticker", "ann", "incremental")


def rule_classes(markets: DataFrame) -> DataFrame:
    k = F.pmod("ticker", F.lit(4))
    rules = F.when(k == 0, "as deemed by").when(k == 1, "signed into law").when(k == 2, "the price is 5").otherwise("else")
    none = F.lit(None).cast("double")
    return markets.select("ticker", T.rule_class(rules, none, none, F.lit(None).cast("string")).alias("rule_class"))


@query(
    "x16_rule_objectivity",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {SIDES}, {RULES}, r as ({RULE_CELLS})
    {stats_sql('r', 'cell_id, period', ['ann', 'incremental'], digits=4)}""",
)
def rule_objectivity(spark, d):
    rows = rule_rows(written(side_panel(spark, d)), rule_classes(S.markets(spark, d)))
    return rounded(C.cell_stats(rows, ["cell_id", "period"], ["ann", "incremental"]), 4)


def forecast_panel(calibrated: DataFrame, contracts: DataFrame, reserve: int = 2) -> DataFrame:
    """Contracts on a station's value beside the newest forecast known at the decision, as both strategy sides with model edge."""
    keys = ["station", "weather_stat", "target_date"]
    j = contracts.join(calibrated.select(*keys, "lead_days", "event_id", "forecast_f", "available_at", "calibration_bias_f", "calibration_sigma_f"), keys).where("available_at <= decision_time")
    j = pick(j, ["contract"], [F.desc("available_at"), F.desc("lead_days"), F.desc("event_id")])
    mean = F.col("forecast_f") + F.col("calibration_bias_f")
    p = 1 - normal_cdf(F.col("floor_strike") + 0.5, mean, F.col("calibration_sigma_f"))
    j = j.withColumn("p_yes", p).where("p_yes is not null").withColumn("side", F.explode(E.side_rows()))
    side = F.col("side")
    j = j.withColumn("entry", E.strategy_entry(side, F.col("yes_price_cents"), reserve)).withColumn("p_win", F.when(side == "yes", F.col("p_yes")).otherwise(1 - F.col("p_yes")))
    return j.withColumn("edge", (F.col("p_win") - 0.02) * 100 - F.col("entry") - E.taker_fee(F.col("entry")))


_P_YES = f"(1 - 0.5 * {erfc_sql('(-(floor_strike + 0.5 - mean) / (sigma * sqrt(2.0)))')})"


@query(
    "x21_forecast_panel",
    f"""with {FORECASTS}, {DAILY}, cal as (select f.*, case when c.n >= 30 then c.s / c.n end as bias, case when c.n >= 30 then sqrt(greatest(2.25, (c.q - c.s * c.s / c.n) / (c.n - 1))) end as sigma from forecasts f asof left join cum c on f.station = c.station and f.weather_stat = c.weather_stat and f.lead_days = c.lead_days and f.available_at >= c.known),
    ct as (select station || '-' || weather_stat || '-' || cast(target_date as varchar) as contract, station, weather_stat, target_date, available_at - interval 30 hour as decision_time, floor(observed_f) as floor_strike, cast(1 + cast(floor(observed_f * 7) as bigint) % 99 as bigint) as yes_price_cents from observations),
    j as (select contract, floor_strike, yes_price_cents, forecast_f + bias as mean, sigma from ct join cal using (station, weather_stat, target_date) where cal.available_at <= decision_time qualify row_number() over (partition by contract order by cal.available_at desc, lead_days desc, event_id desc) = 1),
    s as (select contract, side, case when side = 'yes' then {_P_YES} else 1 - {_P_YES} end as p_win, least(99, greatest(1, (case when side = 'yes' then yes_price_cents else 100 - yes_price_cents end) + 2)) as entry from j, (values ('no'), ('yes')) x(side) where sigma is not null)
    select contract, side, entry, round(p_win, 3) as p_win, round((p_win - 0.02) * 100 - entry - (7 * entry * (100 - entry) + 9999) // 10000, 1) as edge from s""",
)
def panel_query(spark, d):
    cal = P.rolling_calibration(forecasts(spark, d), observations(spark, d), least=30)
    o = observations(spark, d)
    contracts = o.select(
        F.concat_ws("-", "station", "weather_stat", "target_date").alias("contract"), "station", "weather_stat", "target_date", (F.col("available_at") - F.expr("interval 30 hours")).alias("decision_time"),
        F.floor("observed_f").cast("double").alias("floor_strike"), (1 + F.pmod(F.floor(F.col("observed_f") * 7).cast("long"), F.lit(99))).alias("yes_price_cents"),
    )
    return forecast_panel(cal, contracts).select("contract", "side", "entry", F.round("p_win", 3).alias("p_win"), F.round("edge", 1).alias("edge"))


@query("x23_tail_veto_families", f"with {S.FILLS}, {FILL_RETURNS}, t as (select 'p<=' || th || '|' || bucket as cell, period, event_ticker, maker from fr, (values (0.05), (0.10), (0.20)) x(th) where yes_price_cents / 100.0 <= th) {stats_sql('t', 'cell, period', ['maker'])}")
def tail_veto(spark, d):
    th = F.filter(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2)), lambda t: F.col("yes_price_cents") / 100.0 <= t)
    f = fill_returns(spark, d).withColumn("th", F.explode(th)).withColumn("cell", F.concat(F.lit("p<="), F.format_number("th", 2), F.lit("|"), "bucket"))
    return rounded(C.cell_stats(f, ["cell", "period"], ["maker"]))


@query(
    "a28_search_funnel",
    f"""with {S.FILLS}, {FILL_RETURNS}, r as (select category as family, bucket as cell, event_ticker, maker from fr), st as ({stats_sql('r', 'family, cell', ['maker'], digits=12)})
    select family, count(*) as registered, count(*) filter (n_events >= 40) as supported, count(*) filter (n_events >= 40 and maker_mean - maker_se > -0.2) as passing from st group by family""",
)
def funnel(spark, d):
    s = C.cell_stats(fill_returns(spark, d).select(F.col("category").alias("family"), F.col("bucket").alias("cell"), "event_ticker", "maker"), ["family", "cell"], ["maker"])
    ok = F.col("n_events") >= 40
    return s.groupBy("family").agg(F.count(F.lit(1)).alias("registered"), F.count_if(ok).alias("supported"), F.count_if(ok & (F.col("maker_mean") - F.col("maker_se") > -0.2)).alias("passing"))


@query("a33_latest_per_series", f"with {S.MARKETS} select series_ticker, max(close_time) as latest, count(*) as markets from markets group by series_ticker")
def latest_per_series(spark, d):
    return S.markets(spark, d).groupBy("series_ticker").agg(F.max("close_time").alias("latest"), F.count(F.lit(1)).alias("markets"))


@query(
    "a32_cadence_and_flow",
    f"with {S.FILLS} select category, sum(case when yes_price_cents <= 5 or yes_price_cents >= 96 then count else 0 end) as extreme, count(distinct ticker) / 12.0 as per_month, round(avg(case when yes_price_cents <= 5 then yes_price_cents / 100.0 - result_yes when yes_price_cents >= 96 then (100 - yes_price_cents) / 100.0 - (1 - result_yes) end), 6) as tail_gap from fills group by category",
)
def cadence(spark, d):
    p, y = F.col("yes_price_cents"), F.col("result_yes")
    gap = F.when(p <= 5, p / 100.0 - y).when(p >= 96, (100 - p) / 100.0 - (1 - y))
    return S.fills(spark, d).groupBy("category").agg(F.sum(F.when((p <= 5) | (p >= 96), F.col("count")).otherwise(0.0)).alias("extreme"), (F.count_distinct("ticker") / 12.0).alias("per_month"), F.round(F.avg(gap), 6).alias("tail_gap"))


@query("a25_fold_shares", f"with {S.FILLS}, e as (select period, event_ticker, count(*) as n from fills group by all) select period, cast(sum(n) as bigint) as n, max(n) as largest, round(max(n) * 1.0 / sum(n), 6) as largest_share from e group by period")
def fold_shares(spark, d):
    e = S.fills(spark, d).groupBy("period", "event_ticker").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("period").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))
