"""The whole suite of mechanisms: fifteen families of cells under one gate and one correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import labels as L
from tidemark.functions.statistics import p_value_sql, sql_round
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.plans.composites import RULE_CELLS, RULES, rule_classes, rule_rows
from tidemark.plans.families import MORE_FAMILIES, more_family_rows, source_classes
from tidemark.plans.labels import ranges_sql
from tidemark.plans.panels import POINTS, points
from tidemark.plans.screens import FILL_RETURNS, fill_returns, stats_sql
from tidemark.plans.suites import FAMILY_CELLS, SIDES, family_rows, side_economics
from tidemark.sources import tables as S
from tidemark.sources.staging import written

EVENTS, HURDLE, Z, PERIODS = 5, 0.0, 1.0, ("early", "middle", "recent")

_MAKER_SIDE = "case when taker_side = 'yes' then 'no' else 'yes' end"
_MAKER_PERIOD = "case year(created_time) % 3 when 0 then 'early' when 1 then 'middle' else 'recent' end"
MAKER_CELLS = f"select 'maker' as family_id, category || '|' || band || '|' || {ranges_sql('yes_price_cents')} || '|' || {_MAKER_SIDE} as cell_id, {_MAKER_PERIOD} as period, event_ticker, maker as ann, cast(null as double) as incremental from fr"


def maker_rows(fills: DataFrame) -> DataFrame:
    """Fills in the cells of category, band, price bucket and the maker's side."""
    side = F.when(F.col("taker_side") == "yes", "no").otherwise("yes")
    k = F.pmod(F.year("created_time"), F.lit(3))
    period = F.when(k == 0, "early").when(k == 1, "middle").otherwise("recent")
    cell = L.cell_key(F.col("category"), F.col("band"), L.suite_bucket(F.col("yes_price_cents")), side)
    return fills.select(F.lit("maker").alias("family_id"), cell.alias("cell_id"), period.alias("period"), "event_ticker", F.col("maker").alias("ann"), F.lit(None).cast("double").alias("incremental"))


def suite_rows(points: DataFrame, markets: DataFrame, fills: DataFrame) -> DataFrame:
    """The rows of all families: panel, listing to source, rules and makers. The decision panel is written once for all of them."""
    known = markets.select("ticker", F.when(F.col("result") == "yes", 1).otherwise(0).alias("result_yes"))
    panel = written(points.where("not is_block_trade").join(known, "ticker"))
    sides = written(side_economics(panel))
    parts = [
        family_rows(sides),
        more_family_rows(panel, P.build_relations(markets), source_classes(markets.select("series_ticker").distinct()).drop("url")),
        rule_rows(sides, rule_classes(markets)).withColumn("family_id", F.lit("rule")),
        maker_rows(fills),
    ]
    columns = ["family_id", "cell_id", "period", "event_ticker", "ann", "incremental"]
    return reduce(DataFrame.unionByName, [p.select(columns) for p in parts])


_GATE = f"n_events >= {EVENTS} and ann_mean - {Z} * ann_se > {HURDLE} and (incremental_mean is null or incremental_mean - {Z} * incremental_se > 0)"
SUITE = f"""suite as (select * from cells union all select * from more union all select 'rule' as family_id, * from ({RULE_CELLS}) union all {MAKER_CELLS}),
 st as ({stats_sql('suite', 'family_id, cell_id, period', ['ann', 'incremental'], digits=12)}),
 c as (select family_id, cell_id, count(*) as n_periods, bool_and(coalesce({_GATE}, false)) as all_pass, max({p_value_sql('ann_mean', 'ann_se', HURDLE)}) as max_p, min(n_events) as min_events, cast(sum(n) as bigint) as n from st group by all),
 s as (select *, case when min_events < {EVENTS} or n_periods < {len(PERIODS)} then 1.0 else max_p end as sp from c),
 r as (select *, row_number() over (partition by family_id order by sp) as fr_, count(*) over (partition by family_id) as fm, row_number() over (order by sp) as r, count(*) over () as m from s)"""


@query(
    "x14_suite_correction",
    f"""with {S.TRADES}, {S.MARKETS}, {S.FILLS}, {FILL_RETURNS}, {POINTS}, {SIDES}, {FAMILY_CELLS}, {MORE_FAMILIES.replace(' cells as (', ' more as (')}, {RULES}, {SUITE}
    select family_id, cell_id, n, n_periods, all_pass, round(least(1.0, min(sp * fm / fr_) over (partition by family_id order by fr_ desc rows unbounded preceding)), 4) as family_q, round(least(1.0, min(sp * m / r) over (order by r desc rows unbounded preceding)), 4) as suite_q from r""",
)
def suite(spark, d):
    """Fifteen families, each cell gated in every period, corrected in its family and over the suite."""
    rows = suite_rows(points(spark, d), S.markets(spark, d), fill_returns(spark, d))
    _, cells = C.evaluate_cells(rows, "ann", EVENTS, HURDLE, Z, incremental="incremental", digits=12)
    q = C.search_correction(cells, EVENTS, len(PERIODS), ranged=True)
    return q.select("family_id", "cell_id", "n", "n_periods", "all_pass", sql_round(F.col("family_q"), 4).alias("family_q"), sql_round(F.col("suite_q"), 4).alias("suite_q"))
