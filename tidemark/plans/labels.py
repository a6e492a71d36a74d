"""Queries of row economics, labels and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import economics as E
from tidemark.functions import labels as L
from tidemark.functions.statistics import bracket_probability, erfc_sql, p_value, p_value_sql
from tidemark.operators.tables import any_cell, excluding, override
from tidemark.sources import tables as S


def P():
    return F.col("yes_price_cents")


def Y():
    return F.col("result_yes")


FEE = "(case when fee_type = 'quadratic_with_maker_fees' then (7 * yes_price_cents * (100 - yes_price_cents) + 39999) // 40000 else 0 end)"
TAKER = "((7 * yes_price_cents * (100 - yes_price_cents) + 9999) // 10000)"


def edges_sql(col, edges=L.SCREEN_EDGES):
    last = len(edges) - 2
    whens = " ".join(f"when {col} >= {lo} and {col} {'<=' if i == last else '<'} {hi} then '{lo:02d}-{hi}'" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"(case {whens} end)"


def ranges_sql(col, ranges=L.SUITE_RANGES):
    return "(case " + " ".join(f"when {col} between {lo} and {hi} then '{lo:02d}-{hi:02d}'" for lo, hi in ranges) + " else 'out' end)"


def period_sql(col, bounds):
    return f"(case when {col} is null then null " + " ".join(f"when {col} < timestamp '{end}' then '{n}'" for n, end in bounds[:-1]) + f" else '{bounds[-1][0]}' end)"


def bins_sql(col, bins):
    return "(case " + " ".join(f"when {col} >= {lo} and {col} < {hi} then '{lo:g}:{hi:g}'" for lo, hi in bins) + " else 'out' end)"


MOVES = ((-100, -10), (-9, -3), (-2, 2), (3, 9), (10, 100))


@query("e01_fees", f"with {S.TRADES}, {S.MARKETS} select trade_id, {TAKER} as taker_fee, {FEE} as maker_fee from trades join markets using (ticker)")
def fees(spark, d):
    df = S.trades(spark, d).join(S.markets(spark, d).select("ticker", "fee_type"), "ticker")
    return df.select("trade_id", E.taker_fee(P()).alias("taker_fee"), E.maker_fee(P(), F.col("fee_type")).alias("maker_fee"))


RET = "({win} - {stake} - {fee}) / {stake}"


@query(
    "e02_e03_returns",
    f"""with {S.FILLS} select category, count(*) as n, round(sum((100.0 * result_yes - yes_price_cents - {TAKER}) / yes_price_cents), 4) as yes_taker,
    round(sum((100.0 * result_yes - m - (case when fee_type = 'quadratic_with_maker_fees' then (7 * m * (100 - m) + 39999) // 40000 else 0 end)) / m), 4) as yes_maker,
    round(sum((100.0 * (1 - result_yes) - (100 - yes_price_cents) - {FEE}) / (100 - yes_price_cents)), 4) as no_maker
    from (select *, least(yes_price_cents + 2, 99) as m from fills) group by category""",
)
def returns(spark, d):
    m = F.least(P() + 2, F.lit(99))
    return (
        S.fills(spark, d)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(E.yes_return(P(), Y(), E.taker_fee(P()))), 4).alias("yes_taker"),
            F.round(F.sum(E.yes_return(m, Y(), E.maker_fee(m, F.col("fee_type")))), 4).alias("yes_maker"),
            F.round(F.sum(E.no_return(P(), Y(), E.maker_fee(P(), F.col("fee_type")))), 4).alias("no_maker"),
        )
    )


@query(
    "e06_p22_two_sided",
    f"""with {S.FILLS} select side, period, count(*) as n, cast(sum(price) as bigint) as price_sum, cast(sum(win) as bigint) as wins, round(sum((100.0 * win - price - {FEE}) / price), 4) as hold
    from (select *, case when side = 'yes' then yes_price_cents else 100 - yes_price_cents end as price, case when side = 'yes' then result_yes else 1 - result_yes end as win
    from fills, (values ('no'), ('yes')) s(side)) group by side, period""",
)
def two_sided(spark, d):
    side = F.col("side")
    df = S.fills(spark, d).withColumn("side", F.explode(E.side_rows()))
    df = df.withColumns({"price": E.side_price(side, P()), "win": E.side_win(side, Y())})
    hold = (100.0 * F.col("win") - F.col("price") - E.maker_fee(P(), F.col("fee_type"))) / F.col("price")
    return df.groupBy("side", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price_sum"), F.sum("win").alias("wins"), F.round(F.sum(hold), 4).alias("hold"))


@query(
    "e07_e13_strategy",
    f"""with {S.FILLS}, x as (select *, case when side = 'yes' then result_yes else 1 - result_yes end as win,
    least(99, greatest(1, case when side = 'yes' then yes_price_cents else 100 - yes_price_cents end + 2)) as entry from fills, (values ('no'), ('yes')) s(side)),
    y as (select *, (7 * entry * (100 - entry) + 9999) // 10000 as fee from x)
    select side, entry, min(fee) as fee, count(*) as n, cast(sum(win) as bigint) as wins, round(avg((100.0 * win - entry - fee) / entry), 6) as hold, round(avg((win - 0.02) * 100 - entry - fee), 6) as edge from y group by side, entry""",
)
def strategy(spark, d):
    side, entry = F.col("side"), F.col("entry")
    df = S.fills(spark, d).withColumn("side", F.explode(E.side_rows()))
    df = df.withColumns({"win": E.side_win(side, Y()), "entry": E.strategy_entry(side, P(), 2)}).withColumn("fee", E.taker_fee(entry))
    return df.groupBy("side", "entry").agg(
        F.min("fee").alias("fee"), F.count(F.lit(1)).alias("n"), F.sum("win").alias("wins"),
        F.round(F.avg((100.0 * F.col("win") - entry - F.col("fee")) / entry), 6).alias("hold"), F.round(F.avg((F.col("win") - 0.02) * 100 - entry - F.col("fee")), 6).alias("edge"),
    )


@query(
    "e09_fill_execution",
    f"""with {S.FILLS} select case when taker_side = 'yes' then 'maker_no' else 'taker_no' end as role, category, count(*) as n,
    round(sum((100.0 * (1 - result_yes) - (100 - yes_price_cents) - case when taker_side = 'yes' then {FEE} else {TAKER} end) / (100 - yes_price_cents)), 4) as hold from fills group by all""",
)
def fill_execution(spark, d):
    maker = F.col("taker_side") == "yes"
    fee = F.when(maker, E.maker_fee(P(), F.col("fee_type"))).otherwise(E.taker_fee(P()))
    df = S.fills(spark, d).withColumn("role", F.when(maker, "maker_no").otherwise("taker_no"))
    return df.groupBy("role", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(E.no_return(P(), Y(), fee)), 4).alias("hold"))


@query(
    "e10_hold_seconds",
    f"""with {S.TRADES}, {S.MARKETS} select trade_id, case when settled_time > created_time then date_diff('second', created_time, settled_time)
    when settled_time is not null and close_time > created_time then date_diff('second', created_time, close_time) else date_diff('second', created_time, expiration_time) end as hold_seconds
    from (select trade_id, ticker, date_trunc('second', created_time) as created_time from trades) join markets using (ticker)""",
)
def hold_seconds(spark, d):
    df = S.trades(spark, d).withColumn("created_time", F.date_trunc("second", "created_time")).join(S.markets(spark, d), "ticker")
    hold = E.hold_seconds(F.col("settled_time"), F.col("created_time"), F.col("close_time"), F.col("settled_time").isNotNull(), F.col("expiration_time"))
    return df.select("trade_id", hold.alias("hold_seconds"))


@query(
    "e11_p_values",
    f"""with g as (select l_suppkey, avg(l_discount) as m, stddev_samp(l_discount) / sqrt(count(*)) as s from lineitem group by l_suppkey)
    select l_suppkey, round({p_value_sql('m', 's', 0.05)}, 6) as p from g""",
)
def p_values(spark, d):
    g = S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    return g.select("l_suppkey", F.round(p_value(F.col("m"), F.col("s"), 0.05), 6).alias("p"))


def cdf_sql(x):
    return f"0.5 * {erfc_sql(f'(-(({x}) - mu) / (sd * sqrt(2.0)))')}"


@query(
    "e12_bracket_probability",
    f"""with x as (select o_orderkey, o_totalprice / 5000 as mu, cast(o_custkey % 5 as double) as sd, cast(o_orderkey % 100 as double) as lo, cast(o_orderkey % 100 + 3 as double) as hi, o_orderkey % 3 as k from orders)
    select o_orderkey, case when sd > 0 then round(case k when 0 then 1 - {cdf_sql('lo + 0.5')} when 1 then {cdf_sql('hi - 0.5')} else {cdf_sql('hi + 0.5')} - {cdf_sql('lo - 0.5')} end, 5) end as p from x""",
)
def brackets(spark, d):
    kind = F.element_at(F.array(F.lit("greater"), F.lit("less"), F.lit("between")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    lo = F.pmod("o_orderkey", F.lit(100)).cast("double")
    p = bracket_probability(kind, lo, lo + 3, F.col("o_totalprice") / 5000, F.pmod("o_custkey", F.lit(5)).cast("double"))
    return S.table(spark, d, "orders").select("o_orderkey", F.round(p, 5).alias("p"))


@query("p14_periods", f"with {S.TRADES} select {period_sql('created_time', S.FOLDS)} as period, count(*) as n, cast(sum(count) as bigint) as contracts from trades group by 1")
def periods(spark, d):
    return S.trades(spark, d).groupBy(L.period(F.col("created_time"), S.FOLDS).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("contracts"))


COARSE = {"01-5": "01-10", "05-10": "01-10", "10-20": "10-30", "20-30": "10-30", "30-40": "30-50", "40-50": "30-50", "50-60": "50-70", "60-70": "50-70", "70-80": "70-90", "80-90": "70-90"}


@query(
    "p15_p20_price_labels",
    f"""with {S.FILLS}, x as (select {edges_sql('yes_price_cents')} as screen, {ranges_sql('yes_price_cents')} as suite, {bins_sql('yes_price_cents - 50', MOVES)} as move,
    case when yes_price_cents <= 5 then 'low' when yes_price_cents <= 50 then 'mid' else 'high' end as band, case when yes_price_cents < 5 then '01-5' when yes_price_cents < 10 then '05-10' else '10-20' end as flow from fills)
    select screen, suite, move, band, flow, case {' '.join(f"when screen = '{a}' then '{b}'" for a, b in COARSE.items())} end as strict, case {' '.join(f"when screen = '{a}' then '{b}'" for a, b in COARSE.items())} else screen end as loose, count(*) as n from x group by all""",
)
def price_labels(spark, d):
    screen = L.screen_bucket(P())
    cols = {
        "screen": screen, "suite": L.suite_bucket(P()), "move": L.fixed_bin(P() - 50, MOVES), "band": L.right_closed(P(), (5, 50), ("low", "mid", "high")), "flow": L.flow_bucket(P()),
        "strict": L.coarse_bucket(screen, COARSE, True), "loose": L.coarse_bucket(screen, COARSE, False),
    }
    return S.fills(spark, d).select(*[c.alias(n) for n, c in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p18_horizon_labels",
    f"""with {S.FILLS} select case when horizon_days < 7 then 'a 1-7d' when horizon_days < 30 then 'b 7-30d' when horizon_days < 90 then 'c 30-90d' when horizon_days < 180 then 'd 90-180d' else 'e 180d+' end as band,
    case when horizon_days < 18 then 7 when horizon_days < 60 then 30 when horizon_days < 135 then 90 else 180 end as nearest, category || '|' || period as cell, count(*) as n from fills group by all""",
)
def horizon_labels(spark, d):
    h = F.col("horizon_days")
    return S.fills(spark, d).groupBy(L.horizon_band(h).alias("band"), L.nearest_horizon(h).alias("nearest"), L.cell_key(F.col("category"), F.col("period")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_p05_tiers_and_bans",
    f"""with {S.MARKETS}, t as (select m.ticker, coalesce(s.tier, 'raw') as tier, series_ticker from markets m left join (select distinct series_ticker as k, case when series_ticker < 3 then 'current' end as tier from markets) s on k = series_ticker)
    select * from t where series_ticker not in (select distinct series_ticker from markets where series_ticker % 4 = 1)""",
)
def tiers_and_bans(spark, d):
    m = S.markets(spark, d)
    series = m.select("series_ticker", F.when(F.col("series_ticker") < 3, "current").alias("new")).distinct()
    df = override(m.select("ticker", "series_ticker", F.lit("raw").alias("tier")), series, "series_ticker", "tier", "new")
    return excluding(df, m.where(F.pmod("series_ticker", F.lit(4)) == 1), "series_ticker").select("ticker", "tier", "series_ticker")


@query("p07_any_cell", f"with {S.FILLS} select category, count(*) as n from fills where (category = 1 and horizon_days = 30 and yes_price_cents between 1 and 5) or (category = 2 and horizon_days = 90 and yes_price_cents between 1 and 10) or (category = 2 and horizon_days = 30 and yes_price_cents between 5 and 20) group by category")
def cells(spark, d):
    spec = spark.createDataFrame([(1, 30, 1, 5), (2, 90, 1, 10), (2, 30, 5, 20)], "category long, horizon_days long, lo long, hi long")
    return any_cell(S.fills(spark, d), spec).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def health_cell(df, category: int, horizon: int, lo: int, hi: int, series: str = "event_ticker", excluded=()):
    """Rows of one health cell, without the excluded series."""
    sub = df.where((F.col("category") == category) & (F.col("horizon_days") == horizon) & P().between(lo, hi))
    return sub.where(~F.col(series).isin(*excluded)) if excluded else sub


@query(
    "p09_health_cells",
    f"with {S.FILLS} select category, horizon_days, count(*) as n, count(distinct event_ticker) as events from fills where (category = 1 and horizon_days = 30 and yes_price_cents between 1 and 20) or (category = 3 and horizon_days = 90 and yes_price_cents between 5 and 40 and event_ticker not in (7, 8, 9, 100)) group by all",
)
def health_cells(spark, d):
    f = S.fills(spark, d)
    both = health_cell(f, 1, 30, 1, 20).union(health_cell(f, 3, 90, 5, 40, excluded=(7, 8, 9, 100)))
    return both.groupBy("category", "horizon_days").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"))


@query(
    "p10_p12_eligible",
    f"with {S.MARKETS} select ticker, date_diff('day', open_time, close_time) as life from markets where volume >= 60 and date_diff('day', open_time, close_time) >= 20 and close_time > timestamp '2024-01-25' and close_time <= timestamp '2024-01-28'",
)
def eligible(spark, d):
    m = S.markets(spark, d)
    now = F.lit("2024-01-25").cast("timestamp_ntz")
    life = F.timestamp_diff("DAY", F.col("open_time"), F.col("close_time"))
    keep = (F.col("volume") >= 60) & (life >= 20) & (F.col("close_time") > now) & (F.col("close_time") <= now + F.expr("interval 72 hours"))
    return m.where(keep).select("ticker", life.alias("life"))


@query(
    "p13_p26_candidates",
    f"""with {S.MARKETS}, {S.TRADES}, l as (select ticker, arg_max(yes_price_cents, created_time) as ask from trades group by ticker),
    c as (select ticker, event_ticker, category, ask, 100 - ask as rest_price, cast(floor(100 * (case when category = 1 then 2 else 1 end) / ((100 - ask) / 100.0)) as bigint) as qty from markets join l using (ticker) where ask between 1 and 40 and close_time between timestamp '2024-01-26' and timestamp '2024-01-30')
    select ticker, event_ticker, ask, rest_price, qty from c where event_ticker not in (select event_ticker from c where event_ticker % 7 = 0) qualify row_number() over (partition by event_ticker order by ask, ticker) = 1""",
)
def candidates(spark, d):
    from tidemark.operators.tables import latest, pick

    last = latest(S.trades(spark, d).select("ticker", "yes_price_cents", "created_time"), "ticker", F.col("created_time")).select("ticker", F.col("yes_price_cents").alias("ask"))
    c = S.markets(spark, d).join(last, "ticker").where(F.col("ask").between(1, 40) & F.col("close_time").between(F.lit("2024-01-26").cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz")))
    size = F.when(F.col("category") == 1, 2).otherwise(1)
    c = c.withColumns({"rest_price": 100 - F.col("ask"), "qty": F.floor(100 * size / ((100 - F.col("ask")) / 100.0)).cast("long")})
    held = c.where(F.pmod("event_ticker", F.lit(7)) == 0).select("event_ticker")
    return pick(excluding(c, held, "event_ticker"), ["event_ticker"], [F.col("ask"), F.col("ticker")]).select("ticker", "event_ticker", "ask", "rest_price", "qty")
