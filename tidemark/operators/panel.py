"""Point-in-time panels: snapshots, decision points, outcomes and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, trailing_sums
from tidemark.operators.dominance import dominance_sums

HOUR, DAY = 3600, 86400
#: Anchor, label and offset in seconds of the registered decision points.
SPECS = tuple(("close", f"T-{n}", s) for n, s in (("1h", HOUR), ("6h", 6 * HOUR), ("1d", DAY), ("3d", 3 * DAY), ("7d", 7 * DAY), ("30d", 30 * DAY), ("90d", 90 * DAY), ("180d", 180 * DAY), ("365d", 365 * DAY))) + tuple(
    ("open", f"O+{n}", s) for n, s in (("1d", DAY), ("7d", 7 * DAY), ("30d", 30 * DAY))
)


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``."""
    return F.timestamp_diff("SECOND", a, b)


def clock_seconds(a: Column, b: Column) -> Column:
    """Seconds from ``a`` to ``b`` as SQL's ``date_diff`` counts them: both are cut to the whole second first."""
    past = F.lit("0001-01-01").cast("timestamp_ntz")
    return seconds(past, b) - seconds(past, a)


def parse_times(markets: DataFrame, columns=("open_time", "close_time", "expiration_time", "settled_time")) -> DataFrame:
    """ISO strings (or timestamps) to timestamps, null where malformed, and the scheduled end."""
    kinds = dict(markets.dtypes)
    parsed = {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") if kinds[c] == "string" else F.col(c) for c in columns if c in kinds}
    return markets.withColumns(parsed).withColumn("scheduled_end_time", F.coalesce("close_time", "expiration_time"))


def decision_grid(markets: DataFrame, specs=SPECS) -> DataFrame:
    """A row for each market and anchor whose time lies in [open, end): one scan, no union."""
    rows = F.array(*[F.struct(F.lit(a).alias("decision_anchor"), F.lit(n).alias("decision_label"), F.lit(s).cast("long").alias("offset_seconds")) for a, n, s in specs])
    df = markets.withColumn("_s", F.explode(rows)).select(*markets.columns, "_s.*")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("offset_seconds"))
    at = F.when(F.col("decision_anchor") == "close", F.col("scheduled_end_time") - shift).otherwise(F.col("open_time") + shift)
    return df.withColumn("decision_time", at).where((F.col("decision_time") >= F.col("open_time")) & (F.col("decision_time") < F.col("scheduled_end_time")))


def build_snapshots(markets: DataFrame, trades: DataFrame, horizons_days=(7, 30, 90, 180, 365)) -> DataFrame:
    """The last trade at or before each horizon's snapshot, with cumulative volume.

    One exchange of the tape serves all horizons. Equal times go by trade_id.
    """
    end = F.coalesce("close_time", "expiration_time")
    resolve = F.coalesce("settled_time", "close_time", "expiration_time")
    m = markets.withColumn("_end", end).withColumn("_resolve", resolve).withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons_days])))
    m = m.withColumn("snap_ts", F.col("_end") - F.make_dt_interval(F.col("horizon_days"))).where("snap_ts >= open_time")
    tape = trades.select("ticker", F.col("created_time").alias("trade_ts"), "trade_id", "yes_price_cents", "count")
    got = asof_join(m, tape, ["ticker"], "snap_ts", "trade_ts", ["trade_id"], running={"cum_volume": F.col("count")}, inner=True)
    return got.select(
        "ticker", "event_ticker", "series_ticker", "category", "fee_type", "horizon_days", "snap_ts", "yes_price_cents", "trade_ts",
        seconds(F.col("trade_ts"), F.col("snap_ts")).alias("staleness_s"), "cum_volume",
        F.timestamp_diff("DAY", F.col("snap_ts"), F.col("_resolve")).alias("hold_days"), "result", (F.col("result") == "yes").cast("int").alias("result_yes"), "volume",
    )


def build_decision_points(markets: DataFrame, trades: DataFrame, specs=SPECS, flow_hours: int = 24) -> DataFrame:
    """As-of price, staleness, age and trailing flows at every decision point; no outcomes."""
    grid = decision_grid(parse_times(markets), specs).select("ticker", "event_ticker", "series_ticker", "category", "fee_type", "open_time", "scheduled_end_time", "can_close_early", "decision_anchor", "decision_label", "offset_seconds", "decision_time")
    tape = trades.select("ticker", F.col("created_time").alias("trade_time"), "trade_id", "yes_price_cents", "is_block_trade", "count")
    at = asof_join(grid, tape, ["ticker"], "decision_time", "trade_time", ["trade_id"], running={"cumulative_volume": F.col("count")}, inner=True).drop("count")
    yes = F.when(F.col("taker_side") == "yes", F.col("count")).otherwise(F.lit(0))
    no = F.when(F.col("taker_side") == "no", F.col("count")).otherwise(F.lit(0))
    flows = trailing_sums(at, trades, ["ticker"], "decision_time", "created_time", flow_hours, {f"volume_{flow_hours}h": F.col("count"), f"yes_volume_{flow_hours}h": yes, f"no_volume_{flow_hours}h": no})
    return flows.withColumns(
        {
            "staleness_seconds": seconds(F.col("trade_time"), F.col("decision_time")),
            "listing_age_seconds": seconds(F.col("open_time"), F.col("decision_time")),
            "scheduled_hold_seconds": seconds(F.col("decision_time"), F.col("scheduled_end_time")),
            # An early close moves the end, so an anchor on it is known only afterwards.
            "decision_time_trustworthy": (F.col("decision_anchor") == "open") | ~F.coalesce("can_close_early", F.lit(False)),
        }
    )


def build_outcomes(markets: DataFrame) -> DataFrame:
    m = parse_times(markets)
    return m.select(
        "ticker", "event_ticker", "result", (F.col("result") == "yes").cast("int").alias("result_yes"),
        F.coalesce("settled_time", "scheduled_end_time").alias("resolution_time"), F.col("settled_time").isNotNull().alias("resolution_time_trustworthy"),
        "scheduled_end_time", seconds(F.col("open_time"), F.col("scheduled_end_time")).alias("scheduled_lifetime_seconds"), "can_close_early",
    )


def repair_outcomes(outcomes: DataFrame, metadata: DataFrame) -> DataFrame:
    """A settlement time from the metadata wins and makes the resolution trustworthy."""
    known = metadata.select("ticker", F.col("settled_time").alias("_settled")).where("_settled is not null")
    df = outcomes.join(known, "ticker", "left")
    return df.withColumns({"resolution_time": F.coalesce("_settled", "resolution_time"), "resolution_time_trustworthy": F.col("resolution_time_trustworthy") | F.col("_settled").isNotNull()}).drop("_settled")


def build_relations(markets: DataFrame) -> DataFrame:
    """Membership rows (never pairs): size, volume and place within the event."""
    event = Window.partitionBy("event_ticker")
    n = F.count(F.lit(1)).over(event)
    return markets.select(
        "ticker", "event_ticker", F.when(n > 1, "event_siblings").otherwise("single").alias("relation_type"),
        n.alias("event_group_size"), F.sum("volume").over(event).alias("event_group_volume"), F.row_number().over(event.orderBy("ticker")).alias("event_member_ordinal"),
    )


def path_rows(points: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Later decision rows beside an earlier one of the same ticker, if a new trade came between: one join for all pairs."""
    prior = points.select("ticker", F.col("decision_label").alias("_early"), F.col("decision_time").alias("prior_decision_time"), F.col("trade_time").alias("prior_trade_time"), F.col("yes_price_cents").alias("prior_yes_price_cents"))
    wanted = F.map_from_entries(F.array(*[F.struct(F.lit(b), F.array(*[F.lit(x) for x, y in pairs if y == b])) for b in dict.fromkeys(y for _, y in pairs)]))
    later = points.withColumn("_early", F.explode(F.coalesce(F.try_element_at(wanted, F.col("decision_label")), F.array().cast("array<string>"))))
    df = later.join(prior, ["ticker", "_early"]).where("prior_decision_time < decision_time and trade_time > prior_decision_time")
    return df.withColumns({"price_move_cents": F.col("yes_price_cents") - F.col("prior_yes_price_cents"), "path_pair": F.concat("_early", F.lit("->"), "decision_label")}).drop("_early")


def sibling_rows(points: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paths with the mean move of the event's other contracts at the same decision."""
    w = Window.partitionBy("event_ticker", "path_pair", "decision_time")
    df = path_rows(points, pairs).withColumns({"_sum": F.sum("price_move_cents").over(w), "_n": F.count(F.lit(1)).over(w)}).where("_n > 1")
    return df.withColumn("sibling_move_cents", (F.col("_sum") - F.col("price_move_cents")) / (F.col("_n") - 1)).drop("_sum", "_n")


def bars(trades: DataFrame, seconds_wide: int = HOUR) -> DataFrame:
    """Hourly bars of a tape: volumes, last price, last YES price; a bar without YES prints has YES volume 0."""
    yes = F.col("taker_side") == "yes"
    order = F.struct("created_time", "trade_id")
    hour = F.date_trunc("hour", "created_time").cast("timestamp_ntz")
    return trades.withColumn("hour", hour).groupBy("ticker", "hour").agg(
        F.sum("count").alias("total_volume"),
        F.sum(F.when(yes, F.col("count")).otherwise(0)).alias("yes_volume"),
        F.max_by("yes_price_cents", order).alias("close_price"),
        F.max_by(F.when(yes, F.col("yes_price_cents")), F.when(yes, order)).alias("yes_close"),
    )


def shock_features(hourly: DataFrame, prior: int = 20, least: int = 10) -> DataFrame:
    """Rolling median of the prior active bars (the current one left out), jump and gap."""
    w = Window.partitionBy("ticker").orderBy("hour")
    before = w.rowsBetween(-prior, -1)
    median = F.when(F.count("yes_volume").over(before) >= least, F.percentile("yes_volume", 0.5).over(before))
    return hourly.withColumns(
        {
            "prior_yes_median": median,
            "yes_share": F.col("yes_volume") / F.col("total_volume"),
            "price_jump": F.col("yes_close") - F.lag("close_price").over(w),
            "previous_gap_hours": seconds(F.lag("hour").over(w), F.col("hour")) / 3600.0,
        }
    )


def select_shocks(features: DataFrame, volume: float = 200, multiple: float = 5, share: float = 0.7, jump: float = 2, gap_hours: float = 24) -> DataFrame:
    """The first bar of each ticker that meets all conditions; the signal is known when the bar ends."""
    hit = features.where(
        (F.col("prior_yes_median") > 0) & (F.col("yes_volume") >= volume) & (F.col("yes_volume") >= multiple * F.col("prior_yes_median")) & (F.col("yes_share") >= share) & (F.col("price_jump") >= jump) & (F.col("previous_gap_hours") <= gap_hours)
    )
    first = hit.groupBy("ticker").agg(F.min_by(F.struct(*[c for c in hit.columns if c != "ticker"]), F.col("hour")).alias("_row")).select("ticker", "_row.*")
    return first.withColumns({"signal_ts": F.col("hour") + F.expr("interval 1 hour"), "shock_price": F.col("yes_close"), "volume_multiple": F.col("yes_volume") / F.col("prior_yes_median")})


def forward_changes(shocks: DataFrame, tape: DataFrame, hours=(24, 168)) -> DataFrame:
    """The latest price after the signal and by each horizon, less the shock price; null without one, and zero-imputed. Equal shock rows are one."""
    right = tape.select("ticker", F.col("created_time").alias("_t"), "trade_id", F.col("yes_price_cents").alias("_p"))
    each = shocks.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn("_target", F.col("signal_ts") + F.make_dt_interval(F.lit(0), F.col("_h")))
    got = asof_join(each, right, ["ticker"], "_target", "_t", ["trade_id"])  # one exchange of the tape for all horizons
    valid = F.coalesce(F.col("_t") > F.col("signal_ts"), F.lit(False))
    got = got.withColumns({"_valid": valid, "_change": F.when(valid, F.col("_p") - F.col("shock_price"))})
    of = lambda h, c: F.max(F.when(F.col("_h") == h, F.col(c)))
    out = got.groupBy(*shocks.columns).agg(*[x for h in hours for x in (of(h, "_valid").alias(f"has_followup_{h}h"), of(h, "_change").alias(f"change_{h}h"))])
    return out.withColumns({f"change_{h}h_zero": F.coalesce(f"change_{h}h", F.lit(0)) for h in hours})


def ladder_pairs(frame: DataFrame) -> DataFrame:
    """Adjacent strikes of an event's ladder: signed gap (a violation of monotony if positive), skew and cost."""
    keys = ["event_ticker", "decision_label", "decision_time", "direction"]
    usable = frame.where(F.col("direction").isin("above", "below") & F.col("floor_strike").isNotNull())
    one = usable.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "floor_strike").orderBy("ticker"))).where("_r = 1").drop("_r")
    w = Window.partitionBy(*keys).orderBy("floor_strike")
    df = one.withColumns({"lower_ticker": F.lag("ticker").over(w), "lower_strike": F.lag("floor_strike").over(w), "lower_yes_price_cents": F.lag("yes_price_cents").over(w), "lower_trade_time": F.lag("trade_time").over(w)})
    df = df.where("lower_ticker is not null").withColumnsRenamed({"ticker": "higher_ticker", "floor_strike": "higher_strike", "yes_price_cents": "higher_yes_price_cents", "trade_time": "higher_trade_time"})
    rise = F.col("higher_yes_price_cents") - F.col("lower_yes_price_cents")
    df = df.withColumns({"signed_gap_cents": F.when(F.col("direction") == "above", rise).otherwise(-rise), "trade_time_skew_seconds": F.abs(seconds(F.col("lower_trade_time"), F.col("higher_trade_time")))})
    df = df.withColumns({"pair_cost_cents": 100 - F.col("signed_gap_cents"), "violation_2c": F.col("signed_gap_cents") >= 2})
    return df.withColumn("paired_return_proxy", F.try_divide(F.col("signed_gap_cents").cast("double"), F.col("pair_cost_cents").cast("double")))


def exclusive_groups(metadata: DataFrame, title_pattern: str = r"(?i)(\bwho will (win|be (the )?.*nominee|become)\b|\bwhich (party|candidate)\b)") -> DataFrame:
    """Events whose contracts are one complete set of exclusive choices."""
    title = F.lower(F.coalesce("title", F.lit("")))
    choice = F.coalesce("yes_sub_title", F.lit(""))
    g = metadata.withColumns({"_t": title, "_c": choice}).groupBy("event_ticker").agg(
        F.count(F.lit(1)).alias("expected_contracts"), F.count_distinct("_t").alias("_titles"), F.count_distinct("_c").alias("_choices"), F.count_if(F.col("_c") == "").alias("_missing"),
        F.count_if(F.col("floor_strike").isNotNull() | F.col("cap_strike").isNotNull()).alias("_numeric"), F.min("_t").alias("_title"),
    )
    ok = (F.col("expected_contracts") >= 2) & (F.col("_titles") == 1) & (F.col("_choices") == F.col("expected_contracts")) & (F.col("_missing") == 0) & (F.col("_numeric") == 0) & F.col("_title").rlike(title_pattern)
    return g.select("event_ticker", ok.alias("is_exclusive_group"), "expected_contracts")


def event_coherence(frame: DataFrame) -> DataFrame:
    """Price sums of complete exclusive groups against 100, the side to buy, its cost and return."""
    keys = ["event_ticker", "decision_label", "decision_time"]
    g = frame.where("is_exclusive_group").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contracts"), F.max("expected_contracts").alias("expected_contracts"), F.sum("yes_price_cents").alias("yes_price_sum_cents"), F.min("trade_time").alias("earliest_trade_time"), F.max("trade_time").alias("latest_trade_time")
    ).where("contracts >= 2 and contracts = expected_contracts")
    over = F.col("yes_price_sum_cents") > 100
    return g.withColumns(
        {
            "dislocation_cents": F.abs(F.col("yes_price_sum_cents") - 100),
            "dislocation_side": F.when(over, "buy_all_no").otherwise("buy_all_yes"),
            "trade_time_skew_seconds": seconds(F.col("earliest_trade_time"), F.col("latest_trade_time")),
            "multi_leg_cost_cents": F.when(over, 100 * F.col("contracts") - F.col("yes_price_sum_cents")).otherwise(F.col("yes_price_sum_cents")),
        }
    ).withColumn("multi_leg_return_proxy", F.try_divide(F.col("dislocation_cents").cast("double"), F.col("multi_leg_cost_cents").cast("double")))


def paper_fills(orders: DataFrame, prints: DataFrame, share: float = 0.5) -> DataFrame:
    """Estimated fills of resting NO orders: YES aggressors at or over the order's YES price since it was placed.

    A pure function of orders and prints, so running it again changes nothing.
    Prints are summed in slots of a cent, so neither side is paired with the other.
    """
    yes = prints.where("taker_side = 'yes'")
    df = dominance_sums(orders, yes, ["ticker"], "placed_ts", "created_time", 100 - F.col("price_c"), F.col("yes_price_cents"), F.col("count"), "_printed")
    df = df.withColumn("filled_qty", F.least(F.col("qty").cast("long"), F.floor(F.col("_printed") * F.lit(share)).cast("long"))).drop("_printed")
    return df.withColumn("state", F.when(F.col("filled_qty") <= 0, "resting").when(F.col("filled_qty") < F.col("qty"), "partial").otherwise("filled"))


def settle_orders(orders: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Realized dollars of NO orders whose market has a result."""
    df = orders.join(outcomes.select("ticker", F.col("result").alias("_result")), "ticker", "left")
    done = F.col("_result").isin("yes", "no")
    payout = F.when(F.col("_result") == "no", 100).otherwise(0)
    return df.withColumns({"realized_usd": F.when(done, F.round(F.col("filled_qty") * (payout - F.col("price_c")) / 100.0, 2)).otherwise(0.0), "state": F.when(done, "settled").otherwise(F.col("state"))}).withColumnRenamed("_result", "result")


def rolling_calibration(forecasts: DataFrame, observations: DataFrame, least: int = 60, floor: float = 2.25) -> DataFrame:
    """Bias and spread of past errors known before each forecast, by station, statistic and lead."""
    groups = ["station", "weather_stat", "lead_days"]
    obs = observations.select("station", "weather_stat", "target_date", "observed_f", F.col("available_at").alias("_known"))
    err = forecasts.join(obs, ["station", "weather_stat", "target_date"]).withColumn("_e", F.col("observed_f") - F.col("forecast_f"))
    daily = err.groupBy(*groups, "target_date").agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("_s"), F.sum(F.col("_e") * F.col("_e")).alias("_q"), F.max("_known").alias("calibration_available_at"))
    running = {"_tn": F.col("_n"), "_ts": F.col("_s"), "_tq": F.col("_q")}
    got = asof_join(forecasts, daily.drop("target_date"), groups, "available_at", "calibration_available_at", running=running)
    enough = F.col("_tn") >= least
    variance = F.try_divide(F.col("_tq") - F.col("_ts") * F.col("_ts") / F.col("_tn"), (F.col("_tn") - 1).cast("double"))
    return got.withColumns({"calibration_bias_f": F.when(enough, F.col("_ts") / F.col("_tn")), "calibration_sigma_f": F.when(enough, F.sqrt(F.greatest(variance, F.lit(floor)))), "calibration_n": F.when(enough, F.col("_tn"))}).drop("_n", "_s", "_q", "_tn", "_ts", "_tq")


#: Edges of the recalibration bins.
RECALIBRATION_EDGES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 1.0)


def recalibration_bin(p: Column, edges=RECALIBRATION_EDGES) -> Column:
    """Index of the half-open bin; the last holds its upper edge; null and non-finite stay null."""
    out = F.when(p.isNull() | F.isnan(p), F.lit(None).cast("int"))
    for i in range(1, len(edges) - 1):
        out = out.when(p < edges[i], i - 1)
    return out.otherwise(len(edges) - 2)


def recalibration_table(df: DataFrame, p: str, y: str, by: list[str] | None = None, bins: int = len(RECALIBRATION_EDGES) - 1) -> DataFrame:
    """Smoothed hit rate of each bin, made monotone; an empty bin inherits the one below."""
    by = by or []
    seen = df.withColumn("bin", recalibration_bin(F.col(p))).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits"))
    spine = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(seen, [*by, "bin"], "left")
    up = Window.partitionBy(*(by or [F.lit(1)])).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.coalesce(F.max((F.col("hits") + 0.5) / (F.col("n") + 1.0)).over(up), F.lit(0.0))
    return full.select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), rate.alias("calibrated"))


def apply_recalibration(df: DataFrame, table: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    small = F.broadcast(table.select(*by, "bin", "calibrated"))  # bins times folds
    return df.withColumn("bin", recalibration_bin(F.col(p))).join(small, [*by, "bin"], "left").drop("bin")


def book_capacity(books: DataFrame, levels: int = 3) -> DataFrame:
    """Latest book of each ticker: best NO price (last level) and dollars on the last levels."""
    last = books.groupBy("ticker").agg(F.max_by(F.struct("no"), F.col("ts")).alias("_b")).select("ticker", "_b.no")
    kept = F.slice("no", -F.least(F.lit(levels), F.size("no")), F.least(F.lit(levels), F.size("no")))
    value = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x[0].cast("double") * x[1].cast("double") / 100.0)
    return last.where(F.size("no") > 0).select("ticker", F.element_at("no", -1)[0].cast("long").alias("best_no_cents"), value.alias("capacity_usd"))


