"""Event-clustered cell statistics and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import benjamini_hochberg, benjamini_hochberg_ranges, p_value, sql_round
from tidemark.sources.staging import written


def cell_stats(df: DataFrame, keys: list[str], values: list[str], cluster: str = "event_ticker", extra: dict[str, Column] | None = None) -> DataFrame:
    """n, n_events and, for each value, mean and clustered standard error by cell.

    se = sqrt(sum over clusters of (sum - count * mean)^2) / n. Rows are first
    combined to (cell, cluster), on the map side too, so a hot cell costs as
    many rows as it has clusters. ``extra`` are sums by name.
    """
    extra = extra or {}
    sums = [F.sum(v).alias(f"_s_{v}") for v in values] + [F.count(v).alias(f"_n_{v}") for v in values]
    by = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_n"), *sums, *[F.sum(e).alias(n) for n, e in extra.items()])
    aggs = [F.sum("_n").alias("n"), F.count(cluster).alias("n_events")]
    for v in values:
        s, m = F.col(f"_s_{v}"), F.col(f"_n_{v}")
        aggs += [F.sum(s).alias(f"_ts_{v}"), F.sum(m).alias(f"_tn_{v}")]
    totals = by.groupBy(*keys).agg(*aggs, *[F.sum(n).alias(n) for n in extra])
    means = totals.select(*keys, "n", "n_events", *[F.try_divide(F.col(f"_ts_{v}"), F.col(f"_tn_{v}").cast("double")).alias(f"{v}_mean") for v in values], *[F.col(f"_tn_{v}") for v in values], *extra)
    # Centred before squaring: the exact form keeps its digits where the expanded one would cancel.
    parts = by.select(*keys, *[c for v in values for c in (f"_s_{v}", f"_n_{v}")])
    renamed = means.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = parts.join(renamed, same) if keys else parts.crossJoin(F.broadcast(renamed))  # one row without keys
    squares = [F.sum(F.pow(F.col(f"_s_{v}") - F.col(f"_n_{v}") * F.col(f"{v}_mean"), 2)).alias(f"_q_{v}") for v in values]
    carried = [F.first(c).alias(c) for c in ("n", "n_events", *[f"{v}_mean" for v in values], *[f"_tn_{v}" for v in values], *extra)]
    out = joined.groupBy(*keys).agg(*carried, *squares)
    return out.select(*keys, "n", "n_events", *[x for v in values for x in (F.col(f"{v}_mean"), (F.sqrt(F.col(f"_q_{v}")) / F.col(f"_tn_{v}")).alias(f"{v}_se"))], *extra)


def residualise(df: DataFrame, match: list[str], value: str, out: str) -> DataFrame:
    """``value`` less its mean over the rows with equal ``match`` columns."""
    mean = df.groupBy(*match).agg(F.avg(value).alias("_base"))
    keyed = df.join(mean, match, "left")
    return keyed.withColumn(out, F.col(value) - F.col("_base")).drop("_base")


def demean_spanning(df: DataFrame, keys: list[str], value: str, span: str, out: str) -> DataFrame:
    """Residuals within groups that span at least two values of ``span``; other groups go."""
    wide = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.min(span).alias("_a"), F.max(span).alias("_b")).where("_a <> _b")
    return df.join(wide.select(*keys, "_mean"), keys).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def top_share(df: DataFrame, keys: list[str], cluster: str = "event_ticker", k: int = 10) -> DataFrame:
    """The share of a cell's rows in its ``k`` largest clusters."""
    by = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_n"))
    ranked = by.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), cluster)))
    return ranked.groupBy(*keys).agg((F.sum(F.when(F.col("_r") <= k, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("top_share"))


def evaluate_cells(df: DataFrame, value: str, minimum_events: int, hurdle: float, z: float, keys=("family_id", "cell_id"), incremental: str | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(period rows, cell rows): a cell passes if every observed period has the
    support and clears the hurdle (and zero, for the incremental value where there is one) at ``z`` errors.

    With ``digits`` the statistics are rounded first, so that a mean of zero is not judged by what is left over from the order of its sum."""
    values = [value] + ([incremental] if incremental else [])
    s = cell_stats(df, [*keys, "period"], values)
    if digits is not None:
        s = s.withColumns({c: sql_round(F.col(c), digits) for v in values for c in (f"{v}_mean", f"{v}_se")})
    low = F.col(f"{value}_mean") - z * F.col(f"{value}_se")
    ok = (F.col("n_events") >= minimum_events) & (low > hurdle)
    if incremental:
        ok = ok & (F.col(f"{incremental}_mean").isNull() | (F.col(f"{incremental}_mean") - z * F.col(f"{incremental}_se") > 0))
    rows = s.withColumn("lower_bound", low).withColumn("p", p_value(F.col(f"{value}_mean"), F.col(f"{value}_se"), hurdle)).withColumn("passes", F.coalesce(ok, F.lit(False)))
    cells = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.bool_and("passes").alias("all_pass"),
        F.max("p").alias("max_p"),
        F.min("lower_bound").alias("min_lower_bound"),
        F.min("n_events").alias("min_events"),
        F.sum("n").alias("n"),
    )
    return rows, cells


def search_correction(cells: DataFrame, minimum_events: int, periods: int, alpha: float = 0.05, ranged: bool = False) -> DataFrame:
    """Family-wise and suite-wise q values; thin or partly observed cells count with p = 1.

    ``ranged`` ranks in ranges of p, for suites of any number of cells; the table is written for that, as it is read several times.
    """
    thin = (F.col("min_events") < minimum_events) | (F.col("n_periods") < periods)
    df = cells.withColumn("search_p", F.when(thin, F.lit(1.0)).otherwise(F.col("max_p")))
    if ranged:
        df = benjamini_hochberg_ranges(written(df), "search_p", "family_q", ["family_id"])
        df = benjamini_hochberg_ranges(written(df), "search_p", "suite_q")
    else:
        df = benjamini_hochberg(df, "search_p", "family_q", ["family_id"])
        df = benjamini_hochberg(df, "search_p", "suite_q")
    fold = F.col("all_pass") & (F.col("n_periods") >= periods)
    return df.withColumn("qualified", fold & (F.col("family_q") <= alpha) & (F.col("suite_q") <= alpha))


def registered_cells(cells: DataFrame, registered: DataFrame, keys=("family_id", "cell_id")) -> DataFrame:
    """Every registered cell; one never observed has n = 0 and p = 1."""
    out = registered.join(cells, list(keys), "left")
    return out.fillna({"n": 0, "n_periods": 0, "min_events": 0, "max_p": 1.0, "all_pass": False})


def pooling_cascade(df: DataFrame, levels: list[tuple[str, list[str]]], value: str, least: int) -> DataFrame:
    """Cells of the finest level with enough rows in both periods; leftovers fall to
    the next level, and what is left at the end is ``insufficient``.

    Which level a fine cell falls to depends on counts alone, so it is settled on
    the table of fine cells (as many rows as labels combine to) and the rows are
    read once for all levels.
    """
    fine = levels[0][1]
    cells = df.groupBy(*fine).agg(F.count_if(F.col("period") == "discovery").alias("_d"), F.count_if(F.col("period") == "confirmation").alias("_c")).withColumn("level", F.lit(None).cast("string"))
    for name, keys in levels:
        w = Window.partitionBy(*keys)
        free = F.col("level").isNull()
        enough = (F.sum(F.when(free, F.col("_d"))).over(w) >= least) & (F.sum(F.when(free, F.col("_c"))).over(w) >= least)
        cells = cells.withColumn("level", F.when(free & enough, name).otherwise(F.col("level")))
    cells = cells.select(*[F.col(k).alias(f"_{k}") for k in fine], F.coalesce("level", F.lit("insufficient")).alias("level"))
    same = F.lit(True)
    for k in fine:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = df.join(F.broadcast(cells), same)  # one row a fine cell
    kept = {k: ["insufficient", *[n for n, keys in levels if k in keys]] for k in fine}
    rows = rows.withColumns({k: F.when(F.col("level").isin(*kept[k]), F.col(k)) for k in fine})
    s = cell_stats(rows, ["level", *fine, "period"], [value])
    pooled = F.col("level") != "insufficient"
    wide = [F.max(F.when(pooled & (F.col("period") == p), F.col(c))).alias(f"{p}_{c}") for p in ("discovery", "confirmation") for c in ("n", "n_events", f"{value}_mean", f"{value}_se")]
    return s.groupBy("level", *fine).agg(*wide, F.sum(F.when(~pooled, F.col("n"))).alias("leftover_n"))
