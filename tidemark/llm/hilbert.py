"""Shards of equal row counts along a Hilbert curve over metadata dimensions.

DataFrame functions only. Every dimension is quantised to ``BITS`` bits by rank,
so that cells hold near equal rows whatever the values look like; a dimension's
cells are known by at most 2 ** ``BITS`` values that they begin with. The curve
index of all cells is a table made by Spark (2 ** (BITS * 3) rows, whatever the
corpus holds) and broadcast. Rows are range-sorted by curve index and doc_id, ties
by a number of each row, so a cell, an id or a text that holds a third of all rows
is split over as many ranges as it needs; ranks come from the row counts of the
ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_tie, stage, text_or_empty

SHARDS, BITS = 24, 5


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """(cell, h): the Hilbert index of every cell; ``cell`` packs the coordinates, first one highest."""
    top = 1 << (bits - 1)
    df = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    df = df.select("cell", *[F.shiftright("cell", bits * (dims - 1 - i)).bitwiseAND((1 << bits) - 1).alias(f"x{i}") for i in range(dims)])

    def step(changes: dict[str, Column]) -> None:
        nonlocal df
        df = df.withColumns(changes)

    q = top
    while q > 1:
        p = F.lit(q - 1).cast("long")
        for i in range(dims):
            has = F.col(f"x{i}").bitwiseAND(q) != 0
            swap = F.col("x0").bitwiseXOR(F.col(f"x{i}")).bitwiseAND(p)
            if i == 0:
                step({"x0": F.when(has, F.col("x0").bitwiseXOR(p)).otherwise(F.col("x0"))})
            else:
                step({"x0": F.when(has, F.col("x0").bitwiseXOR(p)).otherwise(F.col("x0").bitwiseXOR(swap)), f"x{i}": F.when(has, F.col(f"x{i}")).otherwise(F.col(f"x{i}").bitwiseXOR(swap))})
        q >>= 1
    for i in range(1, dims):
        step({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"x{i - 1}"))})
    turn = F.lit(0).cast("long")
    q = top
    while q > 1:
        turn = turn.bitwiseXOR(F.when(F.col(f"x{dims - 1}").bitwiseAND(q) != 0, F.lit(q - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        q >>= 1
    step({"t": turn})
    step({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.col("t")) for i in range(dims)})
    h = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            h = F.shiftleft(h, 1).bitwiseOR(F.shiftright(F.col(f"x{i}"), bit).bitwiseAND(1))
    return df.select("cell", h.alias("h"))


def range_ranks(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-sorted and written, with ``_before`` (weight ``_n`` of all rows before) and ``_total``."""
    sorted_ = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    # One row for each range: bounded by the number of partitions.
    ranges = sorted_.groupBy("_part").agg(F.sum("_n").alias("_k"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_part", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_ahead"), F.sum("_k").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_.join(F.broadcast(ranges), "_part")
    return placed.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_at", "_part", "_ahead")


def quantised(df: DataFrame, column: str, bits: int) -> Column:
    """The cell of a column's value by rank: rows with smaller values, in ``2 ** bits`` parts of all; null takes the lowest."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("_n"))
    cells = range_ranks(values, "v").select("v", F.expr(f"cast((_before * {1 << bits}) div _total as int)").alias("cell"))
    first = sorted((r["cell"], r["v"]) for r in cells.groupBy("cell").agg(F.min("v").alias("v")).collect())  # one row a cell
    if not first:
        return F.lit(0).cast("long")
    kind = df.schema[column].dataType
    starts, names = F.array(*[F.lit(v).cast(kind) for _, v in first]), F.array(*[F.lit(c).cast("long") for c, _ in first])
    below = F.size(F.filter(starts, lambda b: b <= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(0).cast("long")).otherwise(F.element_at(names, below))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source; other columns are
    ignored): doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard
    (null under this law) and hilbert.

    Dimensions: lang, source and the length of the text (of any length, whole),
    each by rank. Null dimensions take the lowest cell, a null text is empty.
    Ties in the curve go by doc_id, then by text; repeated rows and null doc_ids (first in
    their cell) take slots of their own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    base = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.col("lang").cast("string").alias("d0"),
            F.col("source").cast("string").alias("d1"),
            F.char_length(text).cast("long").alias("d2"),
        )
    )
    dims = ["d0", "d1", "d2"]
    cell = F.lit(0).cast("long")
    for d in dims:
        cell = F.shiftleft(cell, bits).bitwiseOR(quantised(base, d, bits))
    keyed = base.withColumn("tie", row_tie()).withColumn("cell", cell).join(F.broadcast(curve(spark, len(dims), bits)), "cell")
    ordered = range_ranks(keyed.select("doc_id", "size", "text_crc32", "h", "tie", F.lit(1).cast("long").alias("_n")), "h", "doc_id", "text_crc32", "tie")
    placed = ordered.withColumnsRenamed({"_before": "_rank", "_total": "total"}).withColumn("shard", F.expr(f"cast((_rank * {shards}) div total as int)"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_rank - (cast(shard as bigint) * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("h").alias("hilbert"),
    )
