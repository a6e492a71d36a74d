"""Queries of hypothesis grids, search correction and conditional families."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.functions.statistics import benjamini_hochberg, benjamini_hochberg_ranges, p_value, p_value_sql, sql_round
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.plans.labels import FEE, bins_sql, period_sql, ranges_sql
from tidemark.plans.panels import PAIRS, PATHS, POINTS, points
from tidemark.plans.screens import FILL_RETURNS, fill_returns, rounded, stats_sql
from tidemark.sources import tables as S
from tidemark.sources.staging import written

BUCKETS = ((1, 10), (11, 30), (31, 60), (61, 99), (1, 50))
BANDS = ("a 1-7d", "b 7-30d", "c 30-90d", "d 90-180d", "e 180d+")
GATE = dict(minimum_events=20, hurdle=-0.2, z=1.0)


def hypothesis_grid(spark, categories: DataFrame, bands=BANDS, buckets=BUCKETS) -> DataFrame:
    """One row for each category, band and inclusive price range; the list is as long as the registry."""
    ranges = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in buckets])
    grid = categories.distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands]))).withColumn("_r", F.explode(ranges))
    return grid.select("category", "band", "_r.lo", "_r.hi", F.concat(F.col("category").cast("string"), F.lit("|"), F.col("band"), F.lit("|"), F.col("_r.lo").cast("string"), F.lit("-"), F.col("_r.hi").cast("string")).alias("hypothesis_id"))


def evaluate_grid(df: DataFrame, grid: DataFrame, periods: list[str], minimum_events: int, hurdle: float, z: float) -> DataFrame:
    """A row for each hypothesis and period, empty ones too. Rows are first summed by
    (category, band, price, period, event), so overlapping price ranges multiply these sums and not the rows."""
    small = df.groupBy("category", "band", "yes_price_cents", "period", "event_ticker").agg(F.sum("maker").alias("s"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("maker") < 0).alias("losses"))
    inside = (small["category"] == grid["category"]) & (small["band"] == grid["band"]) & small["yes_price_cents"].between(grid["lo"], grid["hi"])
    per = small.join(F.broadcast(grid), inside).groupBy("hypothesis_id", "period", "event_ticker").agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.sum("losses").alias("losses"))
    w = Window.partitionBy("hypothesis_id", "period")
    mean = F.sum("s").over(w) / F.sum("m").over(w)
    ranked = per.withColumns({"mean": mean, "_r": F.row_number().over(w.orderBy(F.desc("m"), "event_ticker"))})
    rows = ranked.groupBy("hypothesis_id", "period").agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_events"), F.max("mean").alias("mean"), (F.sqrt(F.sum(F.pow(F.col("s") - F.col("m") * F.col("mean"), 2))) / F.sum("m")).alias("se"),
        (F.sum(F.when(F.col("_r") <= 10, F.col("m")).otherwise(0)) / F.sum("m")).alias("top10_share"), (F.sum("losses") / F.sum("m")).alias("tail_loss_rate"),
    )
    full = grid.select("hypothesis_id", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")).join(rows, ["hypothesis_id", "period"], "left").fillna({"n": 0, "n_events": 0})
    low = F.col("mean") - z * F.col("se")
    return full.withColumns({"lower_bound": low, "p": p_value(F.col("mean"), F.col("se"), hurdle), "passes": F.coalesce((F.col("n_events") >= minimum_events) & (low > hurdle), F.lit(False))})


def verdicts(rows: DataFrame, minimum_events: int, hurdle: float, alpha: float = 0.05) -> DataFrame:
    """Worst p, search-corrected q and a verdict for each hypothesis."""
    thin = F.array_join(F.sort_array(F.collect_list(F.when(F.col("n_events") < minimum_events, F.col("period")))), ",")
    fail = F.array_join(F.sort_array(F.collect_list(F.when(F.col("lower_bound") <= hurdle, F.col("period")))), ",")
    one = rows.groupBy("hypothesis_id").agg(F.bool_and("passes").alias("all_pass"), F.max("p").alias("worst_p"), thin.alias("insufficient"), fail.alias("failing"))
    q = benjamini_hochberg(one, "worst_p", "q")
    verdict = F.when(F.col("all_pass") & (F.col("q") <= alpha), "HISTORICALLY QUALIFIED").when(F.col("all_pass"), "FDR FAIL").when(F.col("failing") != "", "RED").otherwise("INSUFFICIENT SUPPORT")
    return q.withColumn("verdict", verdict)


GRID = f"""grid as (select category, band, lo, hi, category || '|' || band || '|' || lo || '-' || hi as hypothesis_id from (select distinct category from fr), (values {', '.join(f"('{b}')" for b in BANDS)}) b(band), (values {', '.join(str(b) for b in BUCKETS)}) r(lo, hi)),
 hits as (select g.hypothesis_id, f.* from grid g join fr f on f.category = g.category and f.band = g.band and f.yes_price_cents between g.lo and g.hi),
 st as ({stats_sql('hits', 'hypothesis_id, period', ['maker'], digits=12)}),
 rows as (select g.hypothesis_id, p.period, coalesce(n, 0) as n, coalesce(n_events, 0) as n_events, maker_mean as mean, maker_se as se, maker_mean - {GATE['z']} * maker_se as lower_bound, {p_value_sql('maker_mean', 'maker_se', GATE['hurdle'])} as p
 from grid g cross join (values ('discovery'), ('confirmation')) p(period) left join st on st.hypothesis_id = g.hypothesis_id and st.period = p.period)"""


def grid_rows(spark, d):
    f = fill_returns(spark, d)
    return evaluate_grid(f, hypothesis_grid(spark, S.fills(spark, d).select("category")), ["discovery", "confirmation"], **GATE)


@query("a12_j16_grid_folds", f"with {S.FILLS}, {FILL_RETURNS}, {GRID} select hypothesis_id, period, n, n_events, round(mean, 6) as mean, round(se, 6) as se, round(lower_bound, 6) as lower_bound, round(p, 5) as p, coalesce(n_events >= {GATE['minimum_events']} and lower_bound > {GATE['hurdle']}, false) as passes from rows")
def grid_folds(spark, d):
    return grid_rows(spark, d).select("hypothesis_id", "period", "n", "n_events", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("lower_bound", 6).alias("lower_bound"), F.round("p", 5).alias("p"), "passes")


BH = """ranked as (select *, row_number() over (order by worst_p) as r, count(*) over () as m from one), qs as (select *, least(1.0, min(worst_p * m / r) over (order by r desc rows unbounded preceding)) as q from ranked)"""


@query(
    "x13_structural_atlas",
    f"""with {S.FILLS}, {FILL_RETURNS}, {GRID}, one as (select hypothesis_id, bool_and(coalesce(n_events >= {GATE['minimum_events']} and lower_bound > {GATE['hurdle']}, false)) as all_pass, max(p) as worst_p,
    coalesce(string_agg(case when n_events < {GATE['minimum_events']} then period end, ',' order by period), '') as insufficient, coalesce(string_agg(case when lower_bound <= {GATE['hurdle']} then period end, ',' order by period), '') as failing from rows group by hypothesis_id), {BH}
    select hypothesis_id, round(worst_p, 5) as worst_p, round(q, 5) as q, insufficient, failing, case when all_pass and q <= 0.05 then 'HISTORICALLY QUALIFIED' when all_pass then 'FDR FAIL' when failing <> '' then 'RED' else 'INSUFFICIENT SUPPORT' end as verdict from qs""",
)
def structural_atlas(spark, d):
    v = verdicts(grid_rows(spark, d), GATE["minimum_events"], GATE["hurdle"])
    return v.select("hypothesis_id", F.round("worst_p", 5).alias("worst_p"), F.round("q", 5).alias("q"), "insufficient", "failing", "verdict")


@query(
    "a15_false_discovery",
    """with one as (select o_orderkey, (o_orderkey * 7919 % 100003) / 100003.0 as worst_p from (select distinct o_orderkey from orders)), """ + BH + " select o_orderkey, round(q, 6) as q from qs",
)
def false_discovery(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey").distinct().withColumn("p", F.pmod(F.col("o_orderkey") * 7919, F.lit(100003)) / 100003.0)
    return benjamini_hochberg_ranges(o).select("o_orderkey", F.round("q", 6).alias("q"))


# The families below differ in their cells and in what a cell's rows are compared with.
SIDES = f"""sides as (select p.*, side, case when side = 'yes' then yes_price_cents else 100 - yes_price_cents end as price, case when (case when result = 'yes' then 1 else 0 end) = (case when side = 'yes' then 1 else 0 end) then 1 else 0 end as win,
 {period_sql('decision_time', S.FOLDS)} as period from points p, (values ('no'), ('yes')) s(side) where not is_block_trade),
 econ as (select *, hold * 31536000.0 / scheduled + 0.0325 as ann from (select *, (100.0 * win - price - {FEE}) / price as hold, date_diff('second', decision_time, close_time) as scheduled from sides) where scheduled > 0 and period <> 'forward')"""


def side_panel(spark, d):
    m = S.markets(spark, d).select("ticker", F.when(F.col("result") == "yes", 1).otherwise(0).alias("result_yes"))
    return side_economics(points(spark, d).where("not is_block_trade").join(m, "ticker"))


def side_economics(p: DataFrame, folds=S.FOLDS) -> DataFrame:
    """Both sides of every decision row, with maker returns to the scheduled end."""
    side = F.col("side")
    df = p.withColumn("side", F.explode(E.side_rows())).withColumn("period", L.period(F.col("decision_time"), folds)).where("period <> 'forward' and scheduled_hold_seconds > 0")
    df = df.withColumns({"price": E.side_price(side, F.col("yes_price_cents")), "win": E.side_win(side, F.col("result_yes"))})
    hold = (100.0 * F.col("win") - F.col("price") - E.maker_fee(F.col("yes_price_cents"), F.col("fee_type"))) / F.col("price")
    return df.withColumn("hold_return", hold).withColumn("ann", E.annualised_seconds(F.col("hold_return"), F.col("scheduled_hold_seconds")))


#: What a conditional return is measured against: the mean of the rows that are equal in these.
MATCH = ["period", "category", "decision_label", "bucket", "side"]
STALE, SHARE = ((0, 0.02), (0.02, 0.1), (0.1, 0.2), (0.2, 1)), ((0, 0.3), (0.3, 0.7), (0.7, 1.01))
VOLUME = ((0, 1), (1, 20), (20, 60), (60, 10**9))
_STALENESS, _HOLD = "date_diff('second', trade_time, decision_time)", "date_diff('second', decision_time, close_time)"


def staleness():
    """As its SQL counts it; the panel's ``staleness_seconds`` are whole seconds passed, one less where a trade has a fraction of a second."""
    return P.clock_seconds(F.col("trade_time"), F.col("decision_time"))


def _stale():
    return L.fixed_bin(staleness() / F.col("scheduled_hold_seconds"), STALE)


def _label():
    return F.col("decision_label")


class Family(NamedTuple):
    """``keep``: its rows; ``cell``: what its cells are told apart by, beside price bucket and side; each as a Column and as SQL."""

    keep: Callable[[], Column]
    keep_sql: str
    cell: Callable[[], list[Column]]
    cell_sql: str
    matched: bool = True


_ALL = (lambda: F.lit(True), "true")
FAMILIES = {
    "close": Family(lambda: staleness() <= 0.2 * F.col("scheduled_hold_seconds"), f"{_STALENESS} <= 0.2 * {_HOLD}", lambda: [F.col("category"), _label()], "category || '|' || label", False),
    "staleness": Family(lambda: _stale() != "out", f"{bins_sql(f'({_STALENESS} * 1.0 / {_HOLD})', STALE)} <> 'out'", lambda: [_label(), _stale()], f"label || '|' || {bins_sql(f'({_STALENESS} * 1.0 / {_HOLD})', STALE)}"),
    "aggressor": Family(lambda: F.col("volume_24h") >= 20, "volume_24h >= 20", lambda: [_label(), L.fixed_bin(F.try_divide(F.col("yes_volume_24h"), F.col("volume_24h")), SHARE)], f"label || '|' || {bins_sql('(yes_volume_24h * 1.0 / volume_24h)', SHARE)}"),
    "activity": Family(*_ALL, lambda: [_label(), L.fixed_bin(F.col("volume_24h"), VOLUME)], f"label || '|' || {bins_sql('volume_24h', VOLUME)}"),
    "series": Family(*_ALL, lambda: [F.col("series_ticker"), _label()], "series_ticker || '|' || label"),
    "weekday": Family(*_ALL, lambda: [_label(), F.weekday("decision_time") + 1], "label || '|' || isodow(decision_time)"),
    "early-close": Family(*_ALL, lambda: [_label(), F.col("can_close_early")], "label || '|' || case when can_close_early then 'true' else 'false' end"),
}


def family_rows(panel: DataFrame, families: dict[str, Family] = FAMILIES) -> DataFrame:
    """All families in one frame: each row of the panel is exploded to its cells.

    A family's baseline is the mean over its own rows with equal ``MATCH``
    columns; the means of all families come from one aggregation.
    """
    base = panel.withColumn("bucket", L.suite_bucket(F.col("yes_price_cents")))
    kept = dict.fromkeys(f.keep_sql for f in families.values() if f.matched)
    base = base.withColumns({f"_keep{i}": next(f.keep() for f in families.values() if f.keep_sql == k) for i, k in enumerate(kept)})
    means = base.groupBy(*MATCH).agg(*[F.avg(F.when(F.col(f"_keep{i}"), F.col("ann"))).alias(f"_base{i}") for i in range(len(kept))])
    rows = base.join(means, MATCH, "left")
    over = lambda f: F.col("ann") - F.col(f"_base{list(kept).index(f.keep_sql)}") if f.matched else F.lit(None).cast("double")
    cells = F.array(*[F.when(f.keep(), F.struct(F.lit(n).alias("family_id"), L.cell_key(*f.cell(), F.col("bucket"), F.col("side")).alias("cell_id"), over(f).alias("incremental"))) for n, f in families.items()])
    each = rows.withColumn("_c", F.explode(F.filter(cells, lambda c: c.isNotNull())))
    return each.select("_c.family_id", "_c.cell_id", "period", "event_ticker", "ann", "hold_return", "_c.incremental")


def _family_sql(name: str, f: Family) -> str:
    bucket = ranges_sql("yes_price_cents")
    over = f"ann - avg(ann) over (partition by period, category, label, {bucket}, side)" if f.matched else "cast(null as double)"
    return f"select '{name}' as family_id, {f.cell_sql} || '|' || {bucket} || '|' || side as cell_id, period, event_ticker, ann, {over} as incremental from flowing where {f.keep_sql}"


FAMILY_CELLS = f"""flows as (select p.ticker, p.label, coalesce(sum(t.count), 0) as volume_24h, coalesce(sum(case when taker_side = 'yes' then t.count else 0 end), 0) as yes_volume_24h from points p left join trades t on t.ticker = p.ticker and t.created_time > p.decision_time - interval 24 hour and t.created_time <= p.decision_time group by all),
 flowing as (select e.*, volume_24h, yes_volume_24h from econ e join flows f on e.ticker = f.ticker and e.label = f.label),
 cells as ({' union all '.join(_family_sql(n, f) for n, f in FAMILIES.items())})"""
FAMILY_ROWS = f"""{FAMILY_CELLS},
 st as ({stats_sql('cells', 'family_id, cell_id, period', ['ann', 'incremental'], digits=9)})"""


@query(
    "x14_family_periods",
    f"with {S.TRADES}, {S.MARKETS}, {POINTS}, {SIDES}, {FAMILY_ROWS} select family_id, cell_id, period, n, n_events, round(ann_mean, 4) as ann_mean, round(ann_se, 4) as ann_se, case when family_id <> 'close' then round(incremental_mean, 4) + 0.0 end as incremental_mean from st",
)
def family_periods(spark, d):
    s = C.cell_stats(family_rows(written(side_panel(spark, d))), ["family_id", "cell_id", "period"], ["ann", "incremental"])
    four = lambda c: sql_round(sql_round(F.col(c), 9), 4)
    return s.select("family_id", "cell_id", "period", "n", "n_events", four("ann_mean").alias("ann_mean"), four("ann_se").alias("ann_se"), (four("incremental_mean") + 0.0).alias("incremental_mean"))


@query(
    "a13_a16_search_correction",
    f"""with {S.FILLS}, {FILL_RETURNS}, r as (select 'f' || category % 3 as family_id, category || '|' || band as cell_id, period, event_ticker, maker from fr), st as ({stats_sql('r', 'family_id, cell_id, period', ['maker'], digits=12)}),
    p as (select *, maker_mean - maker_se as low, {p_value_sql('maker_mean', 'maker_se', -0.3)} as p from st), c as (select family_id, cell_id, count(*) as n_periods, bool_and(n_events >= 20 and low > -0.3) as all_pass, max(p) as max_p, min(n_events) as min_events, cast(sum(n) as bigint) as n from p group by all),
    s as (select *, case when min_events < 20 or n_periods < 2 then 1.0 else max_p end as sp from c),
    r1 as (select *, row_number() over (partition by family_id order by sp) as fr_, count(*) over (partition by family_id) as fm, row_number() over (order by sp) as r, count(*) over () as m from s)
    select family_id, cell_id, n, n_periods, all_pass, round(least(1.0, min(sp * fm / fr_) over (partition by family_id order by fr_ desc rows unbounded preceding)), 5) as family_q, round(least(1.0, min(sp * m / r) over (order by r desc rows unbounded preceding)), 5) as suite_q from r1""",
)
def correction(spark, d):
    f = fill_returns(spark, d).select(F.concat(F.lit("f"), F.pmod("category", F.lit(3)).cast("string")).alias("family_id"), L.cell_key(F.col("category"), F.col("band")).alias("cell_id"), "period", "event_ticker", "maker")
    _, cells = C.evaluate_cells(f, "maker", 20, -0.3, 1.0)
    q = C.search_correction(cells, 20, 2)
    return q.select("family_id", "cell_id", "n", "n_periods", "all_pass", F.round("family_q", 5).alias("family_q"), F.round("suite_q", 5).alias("suite_q"))


@query(
    "j17_registered_universe",
    f"""with {S.FILLS}, {FILL_RETURNS}, r as (select 'f' as family_id, category || '|' || bucket as cell_id, event_ticker from fr where yes_price_cents < 50), o as (select family_id, cell_id, count(*) as n, count(distinct event_ticker) as n_events from r group by all),
    u as (select distinct 'f' as family_id, category || '|' || b as cell_id from fr, (values ('01-5'), ('40-50'), ('95-99')) x(b)) select u.family_id, u.cell_id, coalesce(n, 0) as n, coalesce(n_events, 0) as n_events from u left join o using (family_id, cell_id)""",
)
def registered(spark, d):
    f = fill_returns(spark, d)
    obs = f.where("yes_price_cents < 50").select(F.lit("f").alias("family_id"), L.cell_key(F.col("category"), F.col("bucket")).alias("cell_id"), "event_ticker").groupBy("family_id", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("n_events"))
    known = f.select("category").distinct().withColumn("b", F.explode(F.array(*[F.lit(b) for b in ("01-5", "40-50", "95-99")]))).select(F.lit("f").alias("family_id"), L.cell_key(F.col("category"), F.col("b")).alias("cell_id"))
    return known.join(obs, ["family_id", "cell_id"], "left").fillna({"n": 0, "n_events": 0})


@query(
    "j18_matched_baseline",
    f"with {S.FILLS}, {FILL_RETURNS}, r as (select *, maker - avg(maker) over (partition by period, bucket) as extra from fr) {stats_sql('r', 'category, period', ['extra'])}",
)
def matched(spark, d):
    return rounded(C.cell_stats(C.residualise(fill_returns(spark, d), ["period", "bucket"], "maker", "extra"), ["category", "period"], ["extra"]))


@query(
    "x19_survivor_audit",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {PATHS}, pr as (select p.ticker, p.event_ticker, p.path_pair, p.price_move_cents, x.trade_id, x.yes_price_cents, t.taker_side from paths p join points x on x.ticker = p.ticker and x.decision_time = p.decision_time
    join trades t on t.ticker = x.ticker and t.created_time = x.trade_time and t.yes_price_cents = x.yes_price_cents where x.label = split_part(p.path_pair, '->', 2))
    select path_pair, taker_side, count(*) as n, count(distinct event_ticker) as events, round(avg(price_move_cents), 6) as mean_move from pr group by all""",
)
def survivor(spark, d):
    from tidemark.operators.panel import path_rows

    path = path_rows(points(spark, d), PAIRS).select("ticker", "event_ticker", "path_pair", "price_move_cents", F.col("trade_time").alias("created_time"), "yes_price_cents")
    prints = S.trades(spark, d).select("ticker", "created_time", "yes_price_cents", "taker_side")
    j = path.join(prints, ["ticker", "created_time", "yes_price_cents"])
    return j.groupBy("path_pair", "taker_side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"), F.round(F.avg("price_move_cents"), 6).alias("mean_move"))


@query(
    "x15_conditional_maker",
    f"""with {S.FILLS}, {FILL_RETURNS}, r as (select {ranges_sql('yes_price_cents')} || '|' || taker_side as cell, period, event_ticker, maker, maker - avg(maker) over (partition by period, {ranges_sql('yes_price_cents')}) as extra from fr) {stats_sql('r', 'cell, period', ['maker', 'extra'])}""",
)
def conditional_maker(spark, d):
    f = fill_returns(spark, d).withColumn("suite", L.suite_bucket(F.col("yes_price_cents")))
    r = C.residualise(f, ["period", "suite"], "maker", "extra").withColumn("cell", L.cell_key(F.col("suite"), F.col("taker_side")))
    return rounded(C.cell_stats(r, ["cell", "period"], ["maker", "extra"]))
