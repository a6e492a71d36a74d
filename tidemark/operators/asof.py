"""As-of joins and trailing flows over a union of both sides, in buckets of a key and a day.

No task sorts the whole history of a key: rows are sorted within (key, day), and
what was last or summed before the day is carried over from one row for each key
and day, which is aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(both: DataFrame, by: list[str], bucket: str, running: list[str], record: bool) -> DataFrame:
    """``both`` (by, _ts, _side, _tie, _run_*, _left, and _right) with _match, the last _right so far, and the sums _run_* so far.

    The last row of each bucket holds what the bucket comes to, so the same
    sorted rows give both the rows and what later buckets carry: both branches
    read all columns of one exchange, which Spark then runs once.
    """
    sums = [f"_run_{n}" for n in running]
    times = {"timestamp", "timestamp_ntz", "date"}
    bucketed = bucket and dict(both.dtypes)["_ts"] in times
    whole = F.struct(*[F.col(f"`{c}`") for c in by])
    # Structs are never null, so the join below adds no filter to one branch only.
    rows = both.withColumn("_key", F.struct(whole.alias("key"), (F.date_trunc(bucket, F.col("_ts").cast("timestamp_ntz")) if bucketed else F.lit(0)).alias("bucket"))).drop(*by)
    order = Window.partitionBy("_key").orderBy("_ts", "_side", "_tie")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    matched = {"_match": F.last("_right", ignorenulls=True).over(inside)} if record else {}
    end = {"_end": F.lead(F.lit(1)).over(order).isNull()} if bucketed else {}
    # The row itself goes through the window too, so that no field of it is pruned from one branch only.
    left = {"_left": F.first("_left").over(order.rowsBetween(0, 0))}
    seen = rows.withColumns(matched | {c: F.sum(c).over(inside) for c in sums} | end | left)
    if not bucketed:
        return seen
    past = Window.partitionBy("_by").orderBy("_bucket")
    so_far = past.rowsBetween(Window.unboundedPreceding, 0)
    state = ([F.last("_match", ignorenulls=True).over(so_far).alias("_match")] if record else []) + [F.sum(c).over(so_far).alias(c) for c in sums]
    last = seen.where("_end").select("_key", F.col("_key.key").alias("_by"), F.col("_key.bucket").alias("_bucket"), *["_match"] * record, *sums, "_left")
    ends = last.select("_key", "_by", "_bucket", *state, "_left")
    carry = ends.select("_key", F.lag(F.struct(*["_match"] * record, *sums, "_left")).over(past).alias("_past"))
    out = seen.join(carry, "_key", "left")
    if record:
        out = out.withColumn("_match", F.coalesce("_match", F.col("_past._match")))
    total = lambda c: F.when(F.col(c).isNull(), F.col(f"_past.{c}")).otherwise(F.col(c) + F.coalesce(F.col(f"_past.{c}"), F.lit(0)))
    return out.withColumns({c: total(c) for c in sums})


def _not_null(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    tiebreak: list[str] | None = None,
    prefix: str = "",
    running: dict[str, Column] | None = None,
    inner: bool = False,
    bucket: str = "day",
) -> DataFrame:
    """Every left row with the last right row at or before its time.

    Both sides are united and sorted by (by, ``bucket`` of the time, time,
    side), so nothing is paired and a left side of many decision times costs its
    rows only; a shorter bucket splits hotter keys. Right rows of equal
    time go by ``tiebreak``, the last wins. ``running`` adds sums over all right
    rows up to that time. Left rows without a match stay, with nulls, unless
    ``inner``. Null keys or times match nothing.
    """
    columns = [c for c in right.columns if c not in by]
    running = running or {}
    record = F.struct(*[F.col(c) for c in columns])
    ties = F.struct(*[F.col(c) for c in tiebreak]) if tiebreak else F.lit(0)
    tail = left.columns
    r = right.where(_not_null([right_ts, *[f"`{c}`" for c in by]])).select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), ties.alias("_tie"), record.alias("_right"), *[e.alias(f"_run_{n}") for n, e in running.items()])
    kind = r.schema["_right"].dataType
    tie = r.schema["_tie"].dataType
    left_record = F.struct(*[F.col(f"`{c}`") for c in tail])
    sums = {n: r.schema[f"_run_{n}"].dataType for n in running}
    l = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(tie).alias("_tie"), F.lit(None).cast(kind).alias("_right"), *[F.lit(None).cast(t).alias(f"_run_{n}") for n, t in sums.items()], left_record.alias("_left"))
    both = r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType)).unionByName(l)
    out = _carried(both, by, bucket, list(running), True).where("_side = 1")
    match = F.when(_not_null([*[f"_key.key.`{c}`" for c in by], "_ts"]), F.col("_match"))
    out = out.withColumn("_match", match)
    if inner:
        out = out.where("_match is not null")
    return out.select(*[F.col(f"_left.`{c}`").alias(c) for c in tail], *[F.col(f"_match.`{c}`").alias(prefix + c) for c in columns], *[F.when(F.col("_match").isNotNull(), F.col(f"_run_{n}")).alias(n) for n in running])


def trailing_sums(points: DataFrame, tape: DataFrame, by: list[str], point_ts: str, tape_ts: str, hours: int, sums: dict[str, Column], bucket: str = "day") -> DataFrame:
    """Adds sums of the tape over ``(t - hours, t]`` at every point.

    A tape row counts from its time on and is taken off again ``hours`` later,
    so the sum so far is that of the span.
    """
    taken = tape.where(_not_null([tape_ts, *[f"`{c}`" for c in by]])).select(*by, F.col(tape_ts).alias("_from"), *[e.alias(f"_run_{n}") for n, e in sums.items()])
    kinds = {n: taken.schema[f"_run_{n}"].dataType for n in sums}
    turn = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign")
    moved = F.when(F.col("_sign") > 0, F.col("_from")).otherwise(F.col("_from") + F.make_dt_interval(F.lit(0), F.lit(hours)))
    r = taken.select("*", turn).select(*by, moved.alias("_ts"), F.lit(0).alias("_side"), F.lit(0).alias("_tie"), *[(F.col(f"_run_{n}") * F.col("_sign")).cast(k).alias(f"_run_{n}") for n, k in kinds.items()])
    l = points.select(*by, F.col(point_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).alias("_tie"), *[F.lit(None).cast(k).alias(f"_run_{n}") for n, k in kinds.items()], F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_left"))
    both = r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType)).unionByName(l)
    out = _carried(both, by, bucket, list(sums), False).where("_side = 1")
    return out.select(*[F.col(f"_left.`{c}`").alias(c) for c in points.columns], *[F.coalesce(F.col(f"_run_{n}"), F.lit(0)).cast(k).alias(n) for n, k in kinds.items()])
