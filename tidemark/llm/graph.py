"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stage, stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (id, component): each vertex of an edge and the smallest id it reaches.

    Every round keeps at most as many edges as it had and moves them towards the
    smallest vertex; aggregates combine on the map side, so a hub of any degree
    is one key of a partial aggregation and a splittable side of a join. Rounds
    are cut by tables in the shared folder. Null ends and loops are ignored; an
    empty input gives an empty table.
    """
    e = stage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        nxt = stage(_small_star(_large_star(e)))
        r = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stage(e)
        e = nxt
        if (r["n"], r["h"]) == mark:
            break
        mark = (r["n"], r["h"])
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    # A fixed point is a set of stars: u -> the smallest vertex v.
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
