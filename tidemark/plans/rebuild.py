"""The structural tables in dependency order, rebuilt where something changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query
from tidemark.operators import cells as C
from tidemark.operators import panel as P
from tidemark.plans import panels, suites
from tidemark.sources import tables as S
from tidemark.sources.artifacts import Step, rebuild
from tidemark.sources.staging import new_folder


def snapshots(markets: DataFrame, trades: DataFrame, horizons=panels.HORIZONS) -> DataFrame:
    return P.build_snapshots(markets, trades, horizons)


def decision_points(markets: DataFrame, trades: DataFrame, specs=panels.SPECS) -> DataFrame:
    return P.build_decision_points(markets, trades, specs)


def bars(trades: DataFrame) -> DataFrame:
    return P.bars(trades.where("not is_block_trade"))


def shocks(hourly: DataFrame, **rule) -> DataFrame:
    return P.select_shocks(P.shock_features(hourly), **rule)


def paths(points: DataFrame, pairs=panels.PAIRS) -> DataFrame:
    return P.path_rows(points, [tuple(p) for p in pairs])


def ladders(points: DataFrame, markets: DataFrame) -> DataFrame:
    return P.ladder_pairs(points.join(markets.select("ticker", "floor_strike", "direction"), "ticker"))


def coherence(points: DataFrame, groups: DataFrame) -> DataFrame:
    return P.event_coherence(points.join(groups, "event_ticker"))


def families(points: DataFrame, outcomes: DataFrame) -> DataFrame:
    panel = suites.side_economics(points.where("not is_block_trade").join(outcomes.select("ticker", "result_yes"), "ticker"))
    return C.cell_stats(suites.family_rows(panel), ["family_id", "cell_id", "period"], ["ann", "incremental"])


def survivors(moved: DataFrame, trades: DataFrame) -> DataFrame:
    prints = trades.select("ticker", F.col("created_time").alias("trade_time"), "yes_price_cents", "taker_side")
    j = moved.join(prints, ["ticker", "trade_time", "yes_price_cents"])
    return j.groupBy("path_pair", "taker_side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_ticker").alias("events"), F.avg("price_move_cents").alias("mean_move"))


STEPS = {
    "snapshots": Step(("markets", "trades"), snapshots, {"horizons": panels.HORIZONS}),
    "decision_points": Step(("markets", "trades"), decision_points, {"specs": panels.SPECS}),
    "outcomes": Step(("markets",), P.build_outcomes),
    "relations": Step(("markets",), P.build_relations),
    "bars": Step(("trades",), bars),
    "shocks": Step(("bars",), shocks, panels.RULE),
    "paths": Step(("decision_points",), paths, {"pairs": panels.PAIRS}),
    "ladders": Step(("decision_points", "markets"), ladders),
    "coherence": Step(("decision_points", "groups"), coherence),
    "families": Step(("decision_points", "outcomes"), families, version=2),
    "survivors": Step(("paths", "trades"), survivors),
}
#: The query whose SQL counts the rows of a step.
COUNTED = {
    "snapshots": "x01_snapshots", "decision_points": "x02_decision_points", "outcomes": "x03_outcomes", "relations": "x04_relations", "bars": "a10_hourly_bars", "shocks": "x12_flow_shocks",
    "paths": "j15_path_rows", "ladders": "w09_ladder_pairs", "coherence": "x18_event_coherence", "families": "x14_family_periods", "survivors": "x19_survivor_audit",
}


def sources(spark, d) -> dict[str, DataFrame]:
    return {"markets": S.markets(spark, d), "trades": S.trades(spark, d), "groups": panels.exclusive(spark, d)}


@query(
    "x26_rebuild",
    " union all ".join(f"select '{s}' as step, (select count(*) from ({ORACLES[q]})) as n, true as first, false as again, {'true' if s == 'coherence' else 'false'} as changed" for s, q in COUNTED.items()),
)
def rebuilt(spark, d):
    """Three runs over the given tables: all is built; nothing is; once the groups have changed, only what reads them is."""
    root, given = f"{new_folder(spark)}/artifacts", sources(spark, d)
    first, again = rebuild(spark, root, given, STEPS), rebuild(spark, root, given, STEPS)
    other = given | {"groups": given["groups"].where("event_ticker % 2 = 0")}
    changed = rebuild(spark, root, other, STEPS)
    row = lambda s: first[s].table.agg(F.lit(s).alias("step"), F.count(F.lit(1)).alias("n"), F.lit(first[s].fresh).alias("first"), F.lit(again[s].fresh).alias("again"), F.lit(changed[s].fresh).alias("changed"))
    return reduce(DataFrame.unionByName, [row(s) for s in STEPS])
