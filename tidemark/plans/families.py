"""Queries of the conditional families whose rows need more than one panel row: listings, paths,
siblings, events, sources and forecasts; and of what is built on their cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.functions import text as T
from tidemark.functions.statistics import p_value_sql
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.plans.labels import bins_sql, edges_sql, ranges_sql
from tidemark.plans.panels import PAIRS, POINTS, points
from tidemark.plans.screens import FILL_RETURNS, LEVELS, fill_returns, rounded, stats_sql
from tidemark.plans.suites import MATCH, SIDES, side_economics, staleness
from tidemark.sources import tables as S

MOVES = ((-100, -20), (-20, -5), (-5, 5), (5, 20), (20, 100))
SIZES = ((1, 2), (2, 5), (5, 20), (20, 10**6))
OPENING = ("O+1d", "O+7d")
SOURCE_CLASS = "case series_ticker % 4 when 0 then 'missing' when 1 then 'government' when 2 then 'exchange_or_data' else 'media_or_other' end"


def source_classes(series: DataFrame) -> DataFrame:
    """(series_ticker) -> series_ticker, source_class, url: each series with a landed list of settlement sources."""
    k = F.pmod("series_ticker", F.lit(4))
    url = F.when(k == 1, "https://www.bureau.gov/x").when(k == 2, "http://prices.nasdaq.com").when(k == 3, "https://paper.example.org/a?b=c")
    listed = F.when(k == 0, "[]").otherwise(F.concat(F.lit('[{"url": "'), url, F.lit('"}]')))
    return series.select("series_ticker", url.alias("url"), T.source_class(listed).alias("source_class"))


def conditional_cells(rows: DataFrame, family: str, condition, match: list[str] | None = MATCH) -> DataFrame:
    """Panel rows as both sides in the cells of a family, with the return over the mean of equal ``match`` columns."""
    df = side_economics(rows).withColumn("bucket", L.suite_bucket(F.col("yes_price_cents")))
    df = C.residualise(df, match, "ann", "incremental") if match else df.withColumn("incremental", F.lit(None).cast("double"))
    return df.select(F.lit(family).alias("family_id"), L.cell_key(condition, F.col("bucket"), F.col("side")).alias("cell_id"), "period", "event_ticker", "ann", "incremental")


def more_family_rows(panel: DataFrame, relations: DataFrame, classes: DataFrame, pairs=PAIRS) -> DataFrame:
    """Listing-age, path, sibling, month, event-size and source cells of the decision panel."""
    label = F.col("decision_label")
    listing = panel.where(label.isin(*OPENING) & (staleness() <= F.col("listing_age_seconds")))
    moved = P.path_rows(panel, pairs).withColumn("bin", L.fixed_bin(F.col("price_move_cents"), MOVES)).where("bin <> 'out'")
    siblings = P.sibling_rows(panel, pairs).withColumn("bin", L.fixed_bin(F.col("sibling_move_cents"), MOVES)).where("bin <> 'out'")
    sized = panel.join(relations.select("ticker", "event_group_size"), "ticker").withColumn("bin", L.fixed_bin(F.col("event_group_size"), SIZES))
    sourced = panel.join(classes, "series_ticker", "left").withColumn("source_class", F.coalesce("source_class", F.lit("missing")))
    parts = [
        conditional_cells(listing, "listing", L.cell_key(F.col("category"), label), None),
        conditional_cells(moved, "path", L.cell_key(F.col("path_pair"), F.col("bin"))),
        conditional_cells(siblings, "sibling", L.cell_key(F.col("path_pair"), F.col("bin"))),
        conditional_cells(panel, "month", L.cell_key(label, F.month("decision_time"))),
        conditional_cells(sized, "event", L.cell_key(label, F.col("bin"))),
        conditional_cells(sourced, "source", L.cell_key(label, F.col("source_class"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _family_sql(name, source, condition, matched=True):
    base = f"ann - avg(ann) over (partition by period, category, label, {ranges_sql('yes_price_cents')}, side)" if matched else "cast(null as double)"
    return f"select '{name}' as family_id, {condition} || '|' || {ranges_sql('yes_price_cents')} || '|' || side as cell_id, period, event_ticker, ann, {base} as incremental from {source}"


_PAIRED = f"(a.label, e.label) in ({', '.join(str(p) for p in PAIRS)})"
MORE_FAMILIES = f"""moved as (select e.*, a.label || '->' || e.label as path_pair, e.yes_price_cents - a.yes_price_cents as move from econ e join points a on a.ticker = e.ticker and {_PAIRED} where a.decision_time < e.decision_time and e.trade_time > a.decision_time and not a.is_block_trade),
 apart as (select *, (sum(move) over w - move) * 1.0 / (count(*) over w - 1) as other from (select p.*, count(*) over (partition by event_ticker, path_pair, decision_time, side) as k from moved p) where k > 1 window w as (partition by event_ticker, path_pair, decision_time, side)),
 sized as (select e.*, n as event_group_size from econ e join (select event_ticker as g, count(*) as n from markets group by 1) on g = e.event_ticker),
 cells as ({_family_sql('listing', "econ where label in ('O+1d', 'O+7d') and date_diff('second', trade_time, decision_time) <= date_diff('second', open_time, decision_time)", "category || '|' || label", False)}
 union all {_family_sql('path', f"(select *, {bins_sql('move', MOVES)} as bin from moved) where bin <> 'out'", "path_pair || '|' || bin")}
 union all {_family_sql('sibling', f"(select *, {bins_sql('other', MOVES)} as bin from apart) where bin <> 'out'", "path_pair || '|' || bin")}
 union all {_family_sql('month', 'econ', "label || '|' || month(decision_time)")}
 union all {_family_sql('event', 'sized', f"label || '|' || {bins_sql('event_group_size', SIZES)}")}
 union all {_family_sql('source', 'econ', f"label || '|' || {SOURCE_CLASS}")})"""


@query(
    "x14_condition_families",
    f"with {S.TRADES}, {S.MARKETS}, {POINTS}, {SIDES}, {MORE_FAMILIES}, st as ({stats_sql('cells', 'family_id, cell_id, period', ['ann', 'incremental'], digits=9)}) select family_id, cell_id, period, n, n_events, round(ann_mean, 4) as ann_mean, round(ann_se, 4) as ann_se, case when family_id <> 'listing' then round(incremental_mean, 4) + 0.0 end as incremental_mean from st",
)
def condition_families(spark, d):
    m = S.markets(spark, d)
    panel = points(spark, d).where("not is_block_trade").join(m.select("ticker", F.when(F.col("result") == "yes", 1).otherwise(0).alias("result_yes")), "ticker")
    rows = more_family_rows(panel, P.build_relations(m), source_classes(m.select("series_ticker").distinct()).drop("url"))
    s = C.cell_stats(rows, ["family_id", "cell_id", "period"], ["ann", "incremental"])
    four = lambda c: F.round(F.round(c, 9), 4)
    return s.select("family_id", "cell_id", "period", "n", "n_events", four("ann_mean").alias("ann_mean"), four("ann_se").alias("ann_se"), (four("incremental_mean") + 0.0).alias("incremental_mean"))


# Forecast contracts from line items: a contract (order) has up to three decisions, both sides of each are rows.
LABELS, STATS, SIDE = ("T-7d", "T-1d", "T-6h"), ("max", "min"), ("no", "yes")
STATIONS, THRESHOLDS, EDGE, UPDATES = 20, (5, 20), 5, (0, 10)
REVISIONS = (("T-7d", "T-1d"), ("T-1d", "T-6h"))
STALE = ((0, 0.02), (0.02, 0.05), (0.05, 1))
FORECAST_GATE = dict(minimum_events=20, hurdle=0.07, z=1.0)

FORECAST_PANEL = f"""wk as (select l_orderkey as ticker, l_linenumber % 3 as k, max(l_partkey) as part, max(l_suppkey) as supp, max(l_quantity) as q, cast(1 + cast(floor(max(l_extendedprice)) as bigint) % 99 as bigint) as yes_price_cents, max(l_discount) as disc, max(l_tax) as tax from lineitem group by 1, 2),
 wp as (select ticker, case k when 0 then 'T-7d' when 1 then 'T-1d' else 'T-6h' end as label, part % 200 as event_ticker, supp % {STATIONS} as station, case when part % 2 = 0 then 'max' else 'min' end as stat, pow((q - 1) / 49.0, 3) as p_yes, yes_price_cents, case when disc > 0.04 then 1 else 0 end as y, tax as stale,
 case ticker % 3 when 0 then 'early' when 1 then 'middle' else 'recent' end as period, case when supp % 4 = 0 then 'quadratic_with_maker_fees' else 'quadratic' end as fee_type from wk)"""
STRATEGY = f"""ws as (select *, (p_win - 0.02) * 100 - entry - fee as edge, (100.0 * win - entry - fee) / entry * 365.0 / 7 + 0.0325 as ann from (select *, (7 * entry * (100 - entry) + 9999) // 10000 as fee from (select wp.*, side, case when side = 'yes' then p_yes else 1 - p_yes end as p_win, case when side = 'yes' then y else 1 - y end as win,
 least(99, greatest(1, (case when side = 'yes' then yes_price_cents else 100 - yes_price_cents end) + 2)) as entry from wp, (values ('no'), ('yes')) s(side)))),
 wr as (select *, ann - avg(ann) over (partition by period, label, {ranges_sql('entry')}, stat, side) as incremental, {ranges_sql('entry')} as bucket, {bins_sql('stale', STALE)} as stale_bin from ws)"""


def forecast_contracts(spark, d) -> DataFrame:
    li = S.table(spark, d, "lineitem")
    k = F.pmod("l_linenumber", F.lit(3))
    one = li.groupBy(F.col("l_orderkey").alias("ticker"), k.alias("k")).agg(*[F.max(f"l_{c}").alias(c) for c in ("partkey", "suppkey", "quantity", "extendedprice", "discount", "tax")])
    return one.select(
        "ticker", F.when(F.col("k") == 0, "T-7d").when(F.col("k") == 1, "T-1d").otherwise("T-6h").alias("decision_label"), F.pmod("partkey", F.lit(200)).alias("event_ticker"), F.pmod("suppkey", F.lit(STATIONS)).alias("station"),
        F.when(F.pmod("partkey", F.lit(2)) == 0, "max").otherwise("min").alias("weather_stat"), F.pow((F.col("quantity") - 1) / 49.0, F.lit(3)).alias("p_yes"), (1 + F.pmod(F.floor("extendedprice").cast("long"), F.lit(99))).cast("long").alias("yes_price_cents"),
        F.when(F.col("discount") > 0.04, 1).otherwise(0).alias("result_yes"), F.col("tax").alias("staleness"), F.when(F.pmod("ticker", F.lit(3)) == 0, "early").when(F.pmod("ticker", F.lit(3)) == 1, "middle").otherwise("recent").alias("period"),
        F.when(F.pmod("suppkey", F.lit(4)) == 0, E.MAKER_FEES).otherwise("quadratic").alias("fee_type"),
    )


def strategy_rows(contracts: DataFrame, reserve: int = 2, days: int = 7) -> DataFrame:
    """Both sides of every decision with model edge after costs, return to settlement and the return over matched rows."""
    side, entry = F.col("side"), F.col("entry")
    df = contracts.withColumn("side", F.explode(E.side_rows())).withColumns(
        {"entry": E.strategy_entry(side, F.col("yes_price_cents"), reserve), "p_win": F.when(side == "yes", F.col("p_yes")).otherwise(1 - F.col("p_yes")), "win": E.side_win(side, F.col("result_yes"))}
    )
    df = df.withColumn("fee", E.taker_fee(entry)).withColumns(
        {
            "edge": (F.col("p_win") - 0.02) * 100 - entry - F.col("fee"),
            "ann": (100.0 * F.col("win") - entry - F.col("fee")) / entry * 365.0 / days + E.CARRY,
            "bucket": L.suite_bucket(entry),
            "stale_bin": L.fixed_bin(F.col("staleness"), STALE),
        }
    )
    return C.residualise(df, ["period", "decision_label", "bucket", "weather_stat", "side"], "ann", "incremental")


def forecast_family_rows(rows: DataFrame) -> DataFrame:
    """Level, city, price, staleness and revision cells: a row is exploded to its cells, revisions pair two decisions of a contract."""
    label, stat, side, edge = (F.col(c) for c in ("decision_label", "weather_stat", "side", "edge"))

    def cell(family, condition, *parts):
        return F.when(condition, F.struct(F.lit(family).alias("family_id"), L.cell_key(*parts, stat, side).alias("cell_id")))

    enough = edge >= EDGE
    cells = [cell("level", edge >= t, label, F.lit(f"edge>={t}")) for t in THRESHOLDS]
    cells += [cell("city", enough, F.col("station"), label), cell("price", enough, label, F.col("bucket")), cell("staleness", enough & (F.col("stale_bin") != "out"), label, F.col("stale_bin"))]
    out = ["period", "event_ticker", "ann", "incremental"]
    single = rows.withColumn("_c", F.explode(F.array_compact(F.array(*cells)))).select("_c.*", *out)
    early = rows.select("ticker", "side", label.alias("_early"), F.col("p_win").alias("_p"), F.col("entry").alias("_entry"))
    before = F.create_map(*[F.lit(x) for e, l in REVISIONS for x in (l, e)])
    later = rows.where(enough).withColumn("_early", F.try_element_at(before, label)).join(early, ["ticker", "side", "_early"])
    later = later.withColumn("_update", ((F.col("p_win") - F.col("_p")) - (F.col("entry") - F.col("_entry")) / 100) * 100)
    moves = [cell("revision", F.col("_update") >= t, F.concat("_early", F.lit("->"), label), F.lit(f"update>={t}")) for t in UPDATES]
    return single.unionByName(later.withColumn("_c", F.explode(F.array_compact(F.array(*moves)))).select("_c.*", *out))


def registered_forecast_cells(spark) -> DataFrame:
    """Every cell that the families register, observed or not; as long as the registry."""
    buckets = [f"{lo:02d}-{hi:02d}" for lo, hi in L.SUITE_RANGES]
    stale = [f"{lo:g}:{hi:g}" for lo, hi in STALE]
    names = [("level", p) for p in product(LABELS, [f"edge>={t}" for t in THRESHOLDS])] + [("city", p) for p in product(map(str, range(STATIONS)), LABELS)]
    names += [("price", p) for p in product(LABELS, buckets)] + [("staleness", p) for p in product(LABELS, stale)] + [("revision", p) for p in product([f"{a}->{b}" for a, b in REVISIONS], [f"update>={t}" for t in UPDATES])]
    return spark.createDataFrame([(f, "|".join((*p, a, b))) for f, p in names for a in STATS for b in SIDE], "family_id string, cell_id string")


def _listed(values):
    return ", ".join(f"('{v}')" for v in values)


_REGISTER = " union all ".join(
    f"select '{f}' as family_id, a || '|' || b || '|' || s || '|' || d as cell_id from (values {_listed(x)}) x(a), (values {_listed(y)}) y(b), (values {_listed(STATS)}) st(s), (values {_listed(SIDE)}) si(d)"
    for f, x, y in (
        ("level", LABELS, [f"edge>={t}" for t in THRESHOLDS]),
        ("city", range(STATIONS), LABELS),
        ("price", LABELS, [f"{lo:02d}-{hi:02d}" for lo, hi in L.SUITE_RANGES]),
        ("staleness", LABELS, [f"{lo:g}:{hi:g}" for lo, hi in STALE]),
        ("revision", [f"{a}->{b}" for a, b in REVISIONS], [f"update>={t}" for t in UPDATES]),
    )
)
_TAIL = "|| '|' || stat || '|' || side as cell_id, period, event_ticker, ann, incremental from"
FORECAST_CELLS = f"""cells as (select 'level' as family_id, label || '|edge>=' || t {_TAIL} wr, (values {', '.join(f'({t})' for t in THRESHOLDS)}) x(t) where edge >= t union all select 'city', station || '|' || label {_TAIL} wr where edge >= {EDGE}
 union all select 'price', label || '|' || bucket {_TAIL} wr where edge >= {EDGE} union all select 'staleness', label || '|' || stale_bin {_TAIL} wr where edge >= {EDGE} and stale_bin <> 'out'
 union all select 'revision', b.label || '->' || a.label || '|update>=' || t || '|' || a.stat || '|' || a.side, a.period, a.event_ticker, a.ann, a.incremental from wr a join wr b on a.ticker = b.ticker and a.side = b.side and (b.label, a.label) in ({', '.join(str(r) for r in REVISIONS)}), (values {', '.join(f'({t})' for t in UPDATES)}) x(t) where a.edge >= {EDGE} and ((a.p_win - b.p_win) - (a.entry - b.entry) / 100) * 100 >= t)"""
GATED = f"""st as ({stats_sql('cells', 'family_id, cell_id, period', ['ann', 'incremental'], digits=12)}), pr as (select *, ann_mean - ann_se as low, incremental_mean - incremental_se as ilow, {p_value_sql('ann_mean', 'ann_se', FORECAST_GATE['hurdle'])} as p from st),
 c as (select family_id, cell_id, count(*) as n_periods, bool_and(n_events >= {FORECAST_GATE['minimum_events']} and low > {FORECAST_GATE['hurdle']} and ilow > 0) as all_pass, max(p) as max_p, min(n_events) as min_events, cast(sum(n) as bigint) as n from pr group by all),
 reg as ({_REGISTER}), full_ as (select reg.family_id, reg.cell_id, coalesce(n_periods, 0) as n_periods, coalesce(all_pass, false) as all_pass, coalesce(max_p, 1.0) as max_p, coalesce(min_events, 0) as min_events, coalesce(n, 0) as n from reg left join c on c.family_id = reg.family_id and c.cell_id = reg.cell_id),
 sp as (select *, case when min_events < {FORECAST_GATE['minimum_events']} or n_periods < 3 then 1.0 else max_p end as sp from full_),
 rk as (select *, row_number() over (partition by family_id order by sp) as fr_, count(*) over (partition by family_id) as fm, row_number() over (order by sp) as r, count(*) over () as m from sp)"""


@query(
    "x22_forecast_families",
    f"""with {FORECAST_PANEL}, {STRATEGY}, {FORECAST_CELLS}, {GATED} select family_id, cell_id, n, n_periods, min_events, all_pass, round(max_p, 5) as max_p, round(least(1.0, min(sp * fm / fr_) over (partition by family_id order by fr_ desc rows unbounded preceding)), 5) as family_q, round(least(1.0, min(sp * m / r) over (order by r desc rows unbounded preceding)), 5) as suite_q from rk""",
)
def forecast_families(spark, d):
    _, cells = C.evaluate_cells(forecast_family_rows(strategy_rows(forecast_contracts(spark, d))), "ann", **FORECAST_GATE, incremental="incremental")
    q = C.search_correction(C.registered_cells(cells, registered_forecast_cells(spark)), FORECAST_GATE["minimum_events"], 3)
    return q.select("family_id", "cell_id", "n", "n_periods", "min_events", "all_pass", F.round("max_p", 5).alias("max_p"), F.round("family_q", 5).alias("family_q"), F.round("suite_q", 5).alias("suite_q"))


# A fold's probabilities are recalibrated on strictly earlier folds; the first fold on itself.
SOURCES = (("early", "early"), ("middle", "early"), ("recent", "early"), ("recent", "middle"))
TAILS, DOUBTS = (0.02, 0.1, 0.5), (0.3, 0.6)
_EDGES = P.RECALIBRATION_EDGES
_BIN = "(case " + " ".join(f"when p_yes < {e} then {i}" for i, e in enumerate(_EDGES[1:-1])) + f" else {len(_EDGES) - 2} end)"
WALKED = f"""wb as (select w.fold, {_BIN} as bin, count(*) as n, sum(y) as hits from wp join (values {', '.join(str(s) for s in SOURCES)}) w(fold, source) on period = source group by all), spine as (select fold, bin from (select distinct fold from wb), (select unnest(range({len(_EDGES) - 1})) as bin)),
 tab as (select s.fold, s.bin, coalesce(max((hits + 0.5) / (n + 1.0)) over (partition by s.fold order by s.bin rows unbounded preceding), 0) as calibrated from spine s left join wb b on b.fold = s.fold and b.bin = s.bin),
 wc as (select w.*, calibrated from (select *, {_BIN} as bin from wp) w join tab on tab.fold = w.period and tab.bin = w.bin)"""


def walk_forward(contracts: DataFrame) -> DataFrame:
    """``contracts`` with ``calibrated``: the model's probability recalibrated on the folds before the row's own."""
    spark = contracts.sparkSession
    folds = spark.createDataFrame(list(SOURCES), "fold string, period string")
    past = contracts.join(F.broadcast(folds), "period").select("fold", "p_yes", "result_yes")
    table = P.recalibration_table(past, "p_yes", "result_yes", ["fold"]).withColumnRenamed("fold", "period")
    return P.apply_recalibration(contracts, table, "p_yes", ["period"])


def maker_channel(calibrated: DataFrame, days: int = 7) -> DataFrame:
    """NO bids resting at the print: maker fee only, and the return over all rows of the same tail, period and label."""
    p = F.col("yes_price_cents")
    rest = 100 - p
    hold = (100.0 * (1 - F.col("result_yes")) - rest - E.maker_fee(p, F.col("fee_type"))) / rest
    return calibrated.withColumn("ann", hold * 365.0 / days + E.CARRY)


def maker_families(calibrated: DataFrame, label: str = "T-1d") -> DataFrame:
    """Tail-veto and favourite-fragility cells of the maker channel."""
    base = maker_channel(calibrated).where((F.col("decision_label") == label) & F.col("calibrated").isNotNull())
    p = F.col("yes_price_cents")

    def cells(part, family, conditions):
        part = C.residualise(part, ["period", "decision_label"], "ann", "incremental")
        listed = F.array_compact(F.array(*[F.when(c, F.lit(f"{label}|{name}")) for name, c in conditions]))
        return part.withColumn("cell_id", F.explode(listed)).select(F.lit(family).alias("family_id"), "cell_id", "period", "event_ticker", "ann", "incremental")

    tails = cells(base.where(p <= 5), "tail-veto", [(f"p<={t}|01-05|no", F.col("calibrated") <= t) for t in TAILS])
    favourites = cells(base.where(p >= 96), "favourite-fragility", [(f"doubt>={m}|96-99|no", p / 100 - F.col("calibrated") >= m) for m in DOUBTS])
    return tails.unionByName(favourites)


_MAKER = "(100.0 * (1 - y) - (100 - yes_price_cents) - (case when fee_type = 'quadratic_with_maker_fees' then (7 * yes_price_cents * (100 - yes_price_cents) + 39999) // 40000 else 0 end)) / (100 - yes_price_cents) * 365.0 / 7 + 0.0325"
MAKER_CELLS = f"""mk as (select *, {_MAKER} as ann from wc where label = 'T-1d'), tl as (select *, ann - avg(ann) over (partition by period) as incremental from mk where yes_price_cents <= 5), fv as (select *, ann - avg(ann) over (partition by period) as incremental from mk where yes_price_cents >= 96),
 mc as (select 'tail-veto' as family_id, 'T-1d|p<=' || t || '|01-05|no' as cell_id, period, event_ticker, ann, incremental from tl, (values {', '.join(f"('{t}', {t})" for t in TAILS)}) x(t, v) where calibrated <= v
 union all select 'favourite-fragility', 'T-1d|doubt>=' || t || '|96-99|no', period, event_ticker, ann, incremental from fv, (values {', '.join(f"('{m}', {m})" for m in DOUBTS)}) x(t, v) where yes_price_cents / 100 - calibrated >= v)"""


@query("x23_maker_families", f"with {FORECAST_PANEL}, {WALKED}, {MAKER_CELLS} {stats_sql('mc', 'family_id, cell_id, period', ['ann', 'incremental'])}")
def maker_family_stats(spark, d):
    return rounded(C.cell_stats(maker_families(walk_forward(forecast_contracts(spark, d))), ["family_id", "cell_id", "period"], ["ann", "incremental"]))


@query(
    "x23_kill_check",
    f"""with {FORECAST_PANEL}, {WALKED} select case when calibrated <= 0.02 then '(0.0, 0.02]' when calibrated <= 0.1 then '(0.02, 0.1]' when calibrated <= 0.5 then '(0.1, 0.5]' else '(0.5, 1.0]' end as band, count(*) as n, count(distinct event_ticker) as events, round(avg(yes_price_cents) / 100, 4) as market_implied, round(avg(y), 4) as realised
    from wc where label = 'T-1d' and yes_price_cents <= 5 and period in ('middle', 'recent') group by 1""",
)
def kill_check(spark, d):
    edges = (0.0, *TAILS, 1.0)
    band = L.right_closed(F.col("calibrated"), TAILS, [f"({a}, {b}]" for a, b in zip(edges, edges[1:])])
    tails = walk_forward(forecast_contracts(spark, d)).where("decision_label = 'T-1d' and yes_price_cents <= 5 and period in ('middle', 'recent') and calibrated is not null")
    return tails.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"), F.round(F.avg("yes_price_cents") / 100, 4).alias("market_implied"), F.round(F.avg("result_yes"), 4).alias("realised"))


# Fixed values of the ranking: how mechanically each class of sources settles, and what is known of hosts.
MECHANICAL = {"government": 1.0, "exchange_or_data": 0.9, "media_or_other": 0.4, "missing": 0.1}
HOSTS = (("bureau.gov", 0.9, 0.8), ("nasdaq.com", 1.0, 0.7))


def information_axes(series: DataFrame, flow: DataFrame, tails: DataFrame, cadence: DataFrame, hosts: DataFrame) -> DataFrame:
    """The six axes of each series and their geometric mean: settlement, upstream, point in time, extreme flow, tail gap, speed."""
    mechanical = F.create_map(*[F.lit(x) for kv in MECHANICAL.items() for x in kv])
    known = series.join(T.host_scores(series, "series_ticker", "url", hosts), "series_ticker")
    j = known.join(flow, "series_ticker", "left").join(tails, "series_ticker", "left").join(cadence, "series_ticker", "left").fillna({"extreme": 0.0, "tail_decisions": 0, "per_month": 0.0})
    top = j.agg(F.max(F.log1p("extreme")).alias("_flow"), F.max(F.log1p("per_month")).alias("_speed"))  # one row
    share = lambda c, t: F.coalesce(F.try_divide(F.log1p(c), F.col(t)), F.lit(0.0))
    axes = j.crossJoin(F.broadcast(top)).withColumns(
        {
            "a1": F.coalesce(F.try_element_at(mechanical, F.col("source_class")), F.lit(0.1)), "a2": F.col("upstream"), "a3": F.col("pit"), "a4": share("extreme", "_flow"),
            "a5": E.tail_gap_score(F.col("tail_gap"), F.col("tail_decisions")), "a6": share("per_month", "_speed"),
        }
    )
    names = [f"a{i}" for i in range(1, 7)]
    return axes.select("series_ticker", "source_class", *names, E.geometric_mean(F.array(*names)).alias("rank_score"))


@query(
    "x20_six_axes",
    f"""with {S.FILLS}, se as (select distinct ticker % 500 as series_ticker from fills), cl as (select series_ticker, {SOURCE_CLASS} as source_class from se),
    fl as (select ticker % 500 as series_ticker, sum(count) as extreme from fills where yes_price_cents <= 5 or yes_price_cents >= 96 group by 1),
    ta as (select ticker % 500 as series_ticker, avg(case when yes_price_cents <= 5 then yes_price_cents / 100.0 - result_yes else (100 - yes_price_cents) / 100.0 - (1 - result_yes) end) as gap, count(*) as k from fills where (yes_price_cents <= 5 or yes_price_cents >= 96) and horizon_days < 100 group by 1),
    ca as (select ticker % 500 as series_ticker, count(distinct ticker) / 12.0 as per_month from fills where created_time > timestamp '1995-06-01' group by 1),
    j as (select cl.*, coalesce(extreme, 0) as extreme, gap, coalesce(k, 0) as k, coalesce(per_month, 0) as per_month from cl left join fl using (series_ticker) left join ta using (series_ticker) left join ca using (series_ticker)),
    ax as (select series_ticker, source_class, case source_class when 'government' then 1.0 when 'exchange_or_data' then 0.9 when 'media_or_other' then 0.4 else 0.1 end as a1, case source_class when 'government' then 0.9 when 'exchange_or_data' then 1.0 else 0.3 end as a2, case source_class when 'government' then 0.8 when 'exchange_or_data' then 0.7 else 0.3 end as a3,
    ln(1 + extreme) / max(ln(1 + extreme)) over () as a4, case when k < 100 or gap is null then 0.3 else greatest(0, least(gap, 0.05)) / 0.05 end as a5, ln(1 + per_month) / max(ln(1 + per_month)) over () as a6 from j)
    select series_ticker, source_class, cast(a1 as double) as a1, cast(a2 as double) as a2, cast(a3 as double) as a3, round(a4, 6) as a4, round(a5, 6) as a5, round(a6, 6) as a6, round(case when least(a4, a5, a6) <= 0 then 0 else exp((ln(a1) + ln(a2) + ln(a3) + ln(a4) + ln(a5) + ln(a6)) / 6) end, 6) as rank_score from ax""",
)
def six_axes(spark, d):
    f = S.fills(spark, d).withColumn("series_ticker", F.pmod("ticker", F.lit(500)))
    p, y = F.col("yes_price_cents"), F.col("result_yes")
    extreme = f.where((p <= 5) | (p >= 96))
    flow = extreme.groupBy("series_ticker").agg(F.sum("count").alias("extreme"))
    gap = F.when(p <= 5, p / 100.0 - y).otherwise((100 - p) / 100.0 - (1 - y))
    tails = extreme.where("horizon_days < 100").groupBy("series_ticker").agg(F.avg(gap).alias("tail_gap"), F.count(F.lit(1)).alias("tail_decisions"))
    cadence = f.where(F.col("created_time") > F.lit("1995-06-01").cast("timestamp_ntz")).groupBy("series_ticker").agg((F.count_distinct("ticker") / 12.0).alias("per_month"))
    hosts = spark.createDataFrame(list(HOSTS), "suffix string, upstream double, pit double")
    return rounded(information_axes(source_classes(f.select("series_ticker").distinct()), flow, tails, cadence, hosts))


def qualified(least: int, hurdle: float) -> Column:
    """Support and a mean two errors above the hurdle in both periods; unknown counts as no."""
    ok = F.lit(True)
    for p in ("discovery", "confirmation"):
        ok = ok & (F.col(f"{p}_n") >= least) & (F.col(f"{p}_maker_mean") - 2 * F.col(f"{p}_maker_se") > hurdle)
    return F.coalesce(ok, F.lit(False))


LEVEL_STATS = ", ".join(f"max(case when period = '{p}' then {c} end) as {p[0]}_{c}" for p in ("discovery", "confirmation") for c in ("n", "maker_mean", "maker_se"))


def _map_level(name, keys, source, rest):
    k = ", ".join(keys)
    on = " and ".join(f"r.{c} = w.{c}" for c in keys)
    return f"""{name}_s as ({stats_sql(source, k + ', period', ['maker'], digits=12)}), {name}_w as (select {k}, {LEVEL_STATS} from {name}_s group by {k} having coalesce(max(case when period = 'discovery' then n end), 0) >= 60 and coalesce(max(case when period = 'confirmation' then n end), 0) >= 60),
    {rest} as (select r.* from {source} r where not exists (select 1 from {name}_w w where {on}))"""


CAPACITY = f"""bk as (select user_id as ticker, date_trunc('day', ts) as day, list([1 + cast(floor(value) as bigint) % 99, 1 + event_id % 30] order by event_id) as no from events group by all), lb as (select ticker, arg_max(no, day) as no from bk group by ticker),
 cp as (select ticker % 6 as category, {edges_sql('(100 - no[-1][1])')} as bucket, round(sum(list_sum(list_transform(no[-3:], lambda x: x[1] * x[2] / 100.0))), 4) as restable_usd, count(*) as open_markets from lb group by all)"""


@query(
    "x09_map_with_capacity",
    f"""with {S.FILLS}, {FILL_RETURNS}, {_map_level('fine', LEVELS[0][1], 'fr', 'r1')}, {_map_level('merged', LEVELS[1][1], 'r1', 'r2')}, {_map_level('pooled', LEVELS[2][1], 'r2', 'r3')}, {CAPACITY},
    mp as (select 'fine' as level, * from fine_w union all by name select 'merged' as level, * from merged_w union all by name select 'pooled' as level, * from pooled_w)
    select level, mp.category, mp.bucket, band, d_n as dn, c_n as cn, round(d_maker_mean, 5) as dm, round(c_maker_mean, 5) as cm, coalesce(d_n >= 60 and c_n >= 60 and d_maker_mean - 2 * d_maker_se > -0.3 and c_maker_mean - 2 * c_maker_se > -0.3, false) as qualified, restable_usd, open_markets from mp left join cp on cp.category = mp.category and cp.bucket = mp.bucket""",
)
def map_with_capacity(spark, d):
    rows = C.pooling_cascade(fill_returns(spark, d), LEVELS, "maker", 60).where("level <> 'insufficient'").withColumn("qualified", qualified(60, -0.3))
    e = S.table(spark, d, "events")
    level = F.struct("event_id", F.array((1 + F.pmod(F.floor("value").cast("long"), F.lit(99))).cast("string"), (1 + F.pmod("event_id", F.lit(30))).cast("string")).alias("l"))
    books = e.groupBy(F.col("user_id").alias("ticker"), F.date_trunc("day", "ts").alias("ts")).agg(F.transform(F.sort_array(F.collect_list(level)), lambda x: x["l"]).alias("no"))
    rest = P.book_capacity(books).withColumns({"category": F.pmod("ticker", F.lit(6)), "bucket": L.screen_bucket(100 - F.col("best_no_cents"))})
    capacity = rest.groupBy("category", "bucket").agg(F.round(F.sum("capacity_usd"), 4).alias("restable_usd"), F.count(F.lit(1)).alias("open_markets"))
    out = rows.join(capacity, ["category", "bucket"], "left")
    return out.select("level", "category", "bucket", "band", F.col("discovery_n").alias("dn"), F.col("confirmation_n").alias("cn"), F.round("discovery_maker_mean", 5).alias("dm"), F.round("confirmation_maker_mean", 5).alias("cm"), "qualified", "restable_usd", "open_markets")
