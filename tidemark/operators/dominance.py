"""Sums over dominating rows: equal keys, not before a time, not over a level; no row is paired with another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from tidemark.sources.staging import written

#: Rows whose running sums are held at once, in a slot a level.
_ROWS = 4096


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls are equal."""
    a, b = column[:-1], column[1:]
    return pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _running(side, level, value, new, state) -> tuple[np.ndarray, np.ndarray]:
    """By row the sum of what its key has had so far up to its level, and by level what the last key has had.

    ``state`` is what the key of the first row has had before, ``new`` where keys begin.
    """
    n = len(side)
    grid = np.zeros((n + 1, len(state)), state.dtype)
    tape = np.flatnonzero(side == 0)
    grid[tape + 1, level[tape]] = value[tape]
    grid[0] = np.diff(state, prepend=0)
    grid = grid.cumsum(0).cumsum(1)
    began = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: it goes on from before
    base = lambda i, at: np.where(i >= 0, grid[i, at], 0)
    at = np.maximum(level, 0)
    sums = np.where(level < 0, 0, grid[np.arange(1, n + 1), at] - base(began, at))
    return sums.astype(state.dtype), grid[n] - base(began[-1], np.arange(len(state)))


def _sweep(keys: int, levels: int, number):
    """Sorted rows (keys, time, side, level, value, point) -> (range, keys, level, point, sum) of the points, and one row with the sums by level of the last key."""

    def run(batches):
        place, state, before, last = TaskContext.get().partitionId(), np.zeros(levels, number), None, None
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                b = whole.slice(start, _ROWS)
                names = b.columns[:keys]
                first = [c[0].as_py() for c in names]
                new = np.append(first != before, np.logical_or.reduce([_changes(c) for c in names]))
                side, level = (b.column(keys + i).to_numpy(zero_copy_only=False) for i in (1, 2))
                value = pc.fill_null(b.column(keys + 3), 0).to_numpy(zero_copy_only=False).astype(number)
                sums, state = _running(side, level, value, new, state)
                before, last = [c[-1].as_py() for c in names], b
                points = np.flatnonzero(side == 1)
                at = pa.array(points)
                kept = [c.take(at) for c in [*names, b.column(keys + 2), b.column(keys + 4)]]
                yield _batch([pa.array(np.full(len(points), place), pa.int32()), *kept, pa.array(sums[points]), pa.nulls(len(points), pa.list_(pa.array(state).type))])
        if last is not None:
            end = last.slice(last.num_rows - 1)
            nothing = [pa.nulls(1, end.column(keys + i).type) for i in (2, 4)]
            yield _batch([pa.array([place], pa.int32()), *end.columns[:keys], *nothing, pa.nulls(1, pa.array(state).type), pa.array([state.tolist()], pa.list_(pa.array(state).type))])

    def _batch(columns):
        return pa.RecordBatch.from_arrays(columns, names=["_range", *(f"_k{i}" for i in range(keys)), "_level", "_point", "_sum", "_by_level"])

    return run


def dominance_sums(points: DataFrame, tape: DataFrame, by: list[str], point_ts: str, tape_ts: str, point_level: Column, tape_level: Column, value: Column, name: str, levels: int = 101) -> DataFrame:
    """Adds ``name`` to every point: the sum of ``value`` over tape rows of its key whose time is not before its own and whose level is not over its own.

    Both sides are sorted once by key and falling time, in ranges of about equal
    size however the keys are spread: every row moves once and a hot key is split.
    A task keeps running sums of the key at hand in ``levels`` slots. Only the last
    key of a range can go on in the next, so one row a range carries over.

    Levels are whole numbers from 0 to ``levels - 1``; others count as the nearest
    (a point below 0 gets 0). Points with a null key, time or level get 0, tape
    rows with a null count nothing.
    """
    spark = points.sparkSession
    names = [f"_k{i}" for i in range(len(by))]
    key = [F.col(f"`{c}`").alias(k) for c, k in zip(by, names)]
    known = F.lit(True)
    for c in by:
        known = known & F.col(f"`{c}`").isNotNull()
    slot = lambda c, low: F.greatest(F.lit(low), F.least(F.lit(levels - 1), F.floor(c).cast("int")))
    point = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    usable = known & F.col(point_ts).isNotNull() & point_level.isNotNull()
    l = points.select(*key, F.col(point_ts).alias("_ts"), F.lit(1).alias("_side"), F.when(usable, slot(point_level, -1)).otherwise(-1).alias("_level"), point.alias("_point"))
    r = tape.where(known & F.col(tape_ts).isNotNull() & tape_level.isNotNull() & value.isNotNull())
    r = r.select(*key, F.col(tape_ts).alias("_ts"), F.lit(0).alias("_side"), slot(tape_level, 0).alias("_level"), value.alias("_value"))
    kind, point_kind = r.schema["_value"].dataType, l.schema["_point"].dataType
    both = r.withColumn("_point", F.lit(None).cast(point_kind)).unionByName(l.withColumn("_value", F.lit(None).cast(kind))).select(*names, "_ts", "_side", "_level", "_value", "_point")
    # Of equal times, tape rows come before points; the hash only spreads ties.
    order = [*[F.col(k).asc_nulls_first() for k in names], F.col("_ts").desc_nulls_last(), F.col("_side").asc(), F.xxhash64("_level", "_value", "_point").asc()]
    ranged = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    number = np.int64 if isinstance(kind, LongType) else np.float64
    total = LongType() if number is np.int64 else DoubleType()
    schema = StructType().add("_range", IntegerType())
    for k in names:
        schema = schema.add(k, both.schema[k].dataType)
    schema = schema.add("_level", IntegerType()).add("_point", point_kind).add("_sum", total).add("_by_level", ArrayType(total))
    swept = written(ranged.mapInArrow(_sweep(len(by), levels, number), schema))

    ends = swept.where("_by_level is not null").select("_range", *names, "_by_level")
    ends = ends.withColumn("_next", F.lead("_range").over(Window.orderBy("_range")))  # one row a range
    slots = ends.where("_next is not null").select("_range", "_next", *names, F.posexplode("_by_level").alias("_level", "_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*names, "_level").orderBy("_range"))
    carried = slots.select(F.col("_next").alias("_range"), *names, "_level", so_far.alias("_before"))
    out = swept.where("_by_level is null").join(carried, ["_range", *names, "_level"], "left")
    return out.select("_point.*", (F.col("_sum") + F.coalesce("_before", F.lit(0))).alias(name))
