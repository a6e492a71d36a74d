"""Deduplication, lookups and set operations with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in the given order (which should be total)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def latest(df: DataFrame, key: str, by: Column) -> DataFrame:
    """The row of each key with the greatest ``by``, as one aggregation (no sort, combined on the map side)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def override(df: DataFrame, lookup: DataFrame, key: str, column: str, new: str) -> DataFrame:
    """``column`` replaced by the lookup's ``new`` where it has one; the lookup has one row a key."""
    return df.join(lookup.select(key, new), key, "left").withColumn(column, F.coalesce(new, column)).drop(new)


def excluding(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``banned``; null keys stay."""
    return df.join(banned.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def missing_keys(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``done`` lacks; empty if it is a subset."""
    return expected.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def any_cell(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows inside at least one cell of (category, horizon_days, lo, hi); the list of cells is broadcast."""
    c = F.broadcast(cells.select(F.col("category").alias("_c"), F.col("horizon_days").alias("_h"), "lo", "hi"))
    inside = (df["category"] == F.col("_c")) & (df["horizon_days"] == F.col("_h")) & df["yes_price_cents"].between(F.col("lo"), F.col("hi"))
    return df.join(c, inside, "left_semi")
