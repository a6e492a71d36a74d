"""Normal tails and search correction as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of a published rational form of erfc, highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def erfc(x: Column) -> Column:
    """Complementary error function (relative error about 1e-7); Spark SQL has none."""
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly: Column = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = poly * t + c
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def erfc_sql(x: str) -> str:
    """The same form as SQL text, for oracles."""
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = repr(ERFC[0])
    for c in ERFC[1:]:
        poly = f"({poly} * {t} + {c!r})"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(case when ({x}) >= 0 then {tail} else 2.0 - {tail} end)"


def sql_round(c: Column, digits: int) -> Column:
    """A double rounded as SQL on doubles does it: scaled, to the nearest whole number, scaled back.

    ``F.round`` goes by the decimal digits, so the two differ where these end in a 5 that the scaling misses by a bit.
    """
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def p_value(mean: Column, se: Column, hurdle: float) -> Column:
    """One-sided normal p of mean over hurdle; 1 where unknown, 0 or 1 where the error is zero."""
    z = F.try_divide(mean - hurdle, se) / F.sqrt(F.lit(2.0))
    return F.when(mean.isNull() | se.isNull() | F.isnan(mean) | F.isnan(se), F.lit(1.0)).when(se == 0, F.when(mean > hurdle, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(0.5 * erfc(z))


def p_value_sql(mean: str, se: str, hurdle: float) -> str:
    z = f"(({mean} - {hurdle}) / nullif({se}, 0) / sqrt(2.0))"
    return f"(case when {mean} is null or {se} is null then 1.0 when {se} = 0 then case when {mean} > {hurdle} then 0.0 else 1.0 end else 0.5 * {erfc_sql(z)} end)"


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    return 0.5 * erfc(-(x - mean) / (sd * F.sqrt(F.lit(2.0))))


def bracket_probability(kind: Column, floor: Column, cap: Column, mean: Column, sd: Column) -> Column:
    """Probability that a whole-number outcome is greater than, less than or between
    strikes, with half-unit continuity; null without a positive spread."""
    ok = (sd > 0) & mean.isNotNull()
    greater = 1 - normal_cdf(floor + 0.5, mean, sd)
    less = normal_cdf(cap - 0.5, mean, sd)
    between = normal_cdf(cap + 0.5, mean, sd) - normal_cdf(floor - 0.5, mean, sd)
    return F.when(ok, F.when(kind == "greater", greater).when(kind == "less", less).when(kind == "between", between))


def benjamini_hochberg(df: DataFrame, p: str = "p", q: str = "q", by: list[str] | None = None) -> DataFrame:
    """Adds adjusted q values within ``by`` (or over all rows).

    For tables of tested cells, which are small; without ``by`` one task ranks
    them (``benjamini_hochberg_ranges`` is for tables of any size). Ties get equal values in whatever order they are ranked.
    """
    keys = by or [F.lit(1)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumn("_rank", rank).withColumn("_m", m)
    from_last = Window.partitionBy(*keys).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(from_last))).drop("_rank", "_m")


def benjamini_hochberg_ranges(df: DataFrame, p: str = "p", q: str = "q", by: list[str] | None = None) -> DataFrame:
    """The same values for a table of any size, within ``by`` (or over all rows), with no task over all rows or over a whole group.

    Equal p have equal q, so distinct values are ranked, in ranges between
    quantiles (as many as shuffle partitions); only counts and least values of
    the ranges of a group are brought together. A null p ranks first and has no
    say in others' values. Values are told apart by the quantiles alone, so that
    every evaluation deals them alike. ``df`` is read three times.
    """
    by = by or []
    names = [f"_by{i}" for i in range(len(by))]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = sorted(set(distinct.select(F.col("_p").cast("double").alias("_p")).approxQuantile("_p", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    limits = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    dealt = distinct.withColumn("_range", F.when(F.col("_p").isNull(), -1).otherwise(F.size(F.filter(limits, lambda b: b <= F.col("_p").cast("double")))))
    # One row a group and range; null group values are groups too.
    group = names or [F.lit(1)]
    counts = dealt.groupBy(*names, "_range").agg(F.sum("_n").alias("_k"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*names, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy(*group)).alias("_m"))
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    keys = [*names, "_range"]
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.alias("d").join(counts.alias("c"), same("d", "c", keys)).select("d.*", "_before", "_m").withColumn("_rank", F.col("_before") + F.sum("_n").over(upto))
    ranked = ranked.withColumn("_value", F.col("_p") * F.col("_m") / F.col("_rank"))
    least = ranked.groupBy(*keys).agg(F.min("_value").alias("_least"))
    after = Window.partitionBy(*group).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, F.min("_least").over(after).alias("_after"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    found = ranked.alias("d").join(least.alias("c"), same("d", "c", keys)).select("d.*", "_after")
    found = found.select(*names, "_p", F.least(F.lit(1.0), F.min("_value").over(down), F.col("_after")).alias(q))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*by, p], [*names, "_p"])])
    return df.join(found, on).drop(*names, "_p")
