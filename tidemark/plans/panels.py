"""Queries of as-of panels, paths, bars, shocks, ladders and coherence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import panel as P
from tidemark.operators.asof import asof_join, trailing_sums
from tidemark.operators.dominance import dominance_sums
from tidemark.sources import tables as S

HORIZONS = (1, 3, 7, 14)
SPECS = (("close", "T-1h", 3600), ("close", "T-1d", 86400), ("close", "T-7d", 7 * 86400), ("open", "O+1d", 86400), ("open", "O+7d", 7 * 86400))
SPEC_ROWS = ", ".join(f"('{a}', '{n}', {s})" for a, n, s in SPECS)




SNAPSHOTS = f"""snapshots as (select m.*, h.horizon_days, close_time - to_days(cast(h.horizon_days as integer)) as snap_ts from markets m, (values {', '.join(f'({h})' for h in HORIZONS)}) h(horizon_days)
 where close_time - to_days(cast(h.horizon_days as integer)) >= open_time),
 tape as (select *, sum(count) over (partition by ticker order by created_time, trade_id rows unbounded preceding) as cum from trades)"""


@query(
    "x01_snapshots",
    f"""with {S.TRADES}, {S.MARKETS}, {SNAPSHOTS} select s.ticker, s.horizon_days, t.yes_price_cents, cast(t.cum as bigint) as cum_volume, cast(floor((epoch_us(s.snap_ts) - epoch_us(t.created_time)) / 1000000) as bigint) as staleness_s,
    cast(date_diff('second', s.snap_ts, coalesce(s.settled_time, s.close_time)) // 86400 as bigint) as hold_days, case when s.result = 'yes' then 1 else 0 end as result_yes
    from snapshots s asof join tape t on s.ticker = t.ticker and s.snap_ts >= t.created_time""",
)
def snapshots(spark, d):
    df = P.build_snapshots(S.markets(spark, d), S.trades(spark, d), HORIZONS)
    return df.select("ticker", "horizon_days", "yes_price_cents", "cum_volume", "staleness_s", "hold_days", "result_yes")


GRID = f"""grid as (select m.*, s.* , case when anchor = 'close' then close_time - to_seconds(offset_seconds) else open_time + to_seconds(offset_seconds) end as decision_time
 from markets m, (values {SPEC_ROWS}) s(anchor, label, offset_seconds) where case when anchor = 'close' then close_time - to_seconds(offset_seconds) else open_time + to_seconds(offset_seconds) end >= open_time
 and case when anchor = 'close' then close_time - to_seconds(offset_seconds) else open_time + to_seconds(offset_seconds) end < close_time)"""
POINTS = f"""{GRID}, tape as (select *, sum(count) over (partition by ticker order by created_time, trade_id rows unbounded preceding) as cum from trades),
 points as (select g.*, t.trade_id, t.created_time as trade_time, t.yes_price_cents, cast(t.cum as bigint) as cumulative_volume, t.is_block_trade from grid g asof join tape t on g.ticker = t.ticker and g.decision_time >= t.created_time)"""


def points(spark, d):
    return P.build_decision_points(S.markets(spark, d), S.trades(spark, d), SPECS)


@query("p25_decision_grid", f"with {S.MARKETS}, {GRID} select ticker, label as decision_label, decision_time from grid")
def grid(spark, d):
    return P.decision_grid(P.parse_times(S.markets(spark, d)), SPECS).select("ticker", "decision_label", "decision_time")


@query(
    "x02_decision_points",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, flows as (select p.ticker, p.label, cast(sum(t.count) as bigint) as v, cast(sum(case when taker_side = 'yes' then t.count else 0 end) as bigint) as y
    from points p left join trades t on t.ticker = p.ticker and t.created_time > p.decision_time - interval 24 hour and t.created_time <= p.decision_time group by all)
    select p.ticker, p.label as decision_label, p.decision_time, p.yes_price_cents, p.trade_id, p.cumulative_volume, coalesce(f.v, 0) as volume_24h, coalesce(f.y, 0) as yes_volume_24h,
    date_diff('second', p.open_time, p.decision_time) as listing_age_seconds, date_diff('second', p.decision_time, p.close_time) as scheduled_hold_seconds, (p.anchor = 'open' or not p.can_close_early) as decision_time_trustworthy
    from points p left join flows f on p.ticker = f.ticker and p.label = f.label""",
)
def decision_points(spark, d):
    return points(spark, d).select("ticker", "decision_label", "decision_time", "yes_price_cents", "trade_id", "cumulative_volume", "volume_24h", "yes_volume_24h", "listing_age_seconds", "scheduled_hold_seconds", "decision_time_trustworthy")


@query(
    "x03_outcomes",
    f"""with {S.MARKETS} select ticker, case when result = 'yes' then 1 else 0 end as result_yes, coalesce(case when ticker % 5 = 0 then timestamp '2024-02-02' end, settled_time, close_time) as resolution_time,
    settled_time is not null or ticker % 5 = 0 as resolution_time_trustworthy, date_diff('second', open_time, close_time) as scheduled_lifetime_seconds from markets""",
)
def outcomes(spark, d):
    m = S.markets(spark, d)
    meta = m.select("ticker", F.when(F.pmod("ticker", F.lit(5)) == 0, F.lit("2024-02-02").cast("timestamp_ntz")).alias("settled_time"))
    return P.repair_outcomes(P.build_outcomes(m), meta).select("ticker", "result_yes", "resolution_time", "resolution_time_trustworthy", "scheduled_lifetime_seconds")


@query(
    "x04_relations",
    f"""with {S.MARKETS} select ticker, event_ticker, case when count(*) over e > 1 then 'event_siblings' else 'single' end as relation_type, count(*) over e as event_group_size, sum(volume) over e as event_group_volume,
    row_number() over (partition by event_ticker order by ticker) as event_member_ordinal from markets window e as (partition by event_ticker)""",
)
def relations(spark, d):
    return P.build_relations(S.markets(spark, d))


PAIRS = [("T-7d", "T-1d"), ("T-1d", "T-1h"), ("T-7d", "T-1h"), ("O+1d", "O+7d")]
PATHS = f"""paths as (select l.ticker, l.event_ticker, l.decision_time, e.label || '->' || l.label as path_pair, l.yes_price_cents - e.yes_price_cents as price_move_cents from points l join points e on l.ticker = e.ticker
 and (e.label, l.label) in ({', '.join(str(p) for p in PAIRS)}) where e.decision_time < l.decision_time and l.trade_time > e.decision_time)"""


@query("j15_path_rows", f"with {S.TRADES}, {S.MARKETS}, {POINTS}, {PATHS} select ticker, path_pair, price_move_cents from paths")
def paths(spark, d):
    return P.path_rows(points(spark, d), PAIRS).select("ticker", "path_pair", "price_move_cents")


@query(
    "w05_sibling_moves",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {PATHS} select ticker, path_pair, round((sum(price_move_cents) over w - price_move_cents) * 1.0 / (count(*) over w - 1), 6) as sibling_move_cents
    from paths window w as (partition by event_ticker, path_pair, decision_time) qualify count(*) over w > 1""",
)
def siblings(spark, d):
    return P.sibling_rows(points(spark, d), PAIRS).select("ticker", "path_pair", F.round("sibling_move_cents", 6).alias("sibling_move_cents"))


@query(
    "j10_trailing_flow",
    f"""with {S.TRADES} select a.trade_id, cast(sum(b.count) as bigint) as v from trades a join trades b on a.ticker = b.ticker and b.created_time > a.created_time - interval 24 hour and b.created_time <= a.created_time group by a.trade_id""",
)
def trailing_flow(spark, d):
    t = S.trades(spark, d)
    return trailing_sums(t.select("ticker", "trade_id", "created_time"), t, ["ticker"], "created_time", "created_time", 24, {"v": F.col("count")}).select("trade_id", "v")


@query(
    "j12_asof_features",
    f"""with {S.TRADES}, f as (select user_id % 20 as entity, ts as available_at, event_id, value from events where event_type in ('signup', 'error')), p as (select event_id as point, user_id % 20 as entity, ts as decision_time from events where event_type = 'purchase')
    select p.point, f.event_id as feature_event_id, f.value as feature_value from p asof left join f on p.entity = f.entity and p.decision_time >= f.available_at""",
)
def features(spark, d):
    e = S.table(spark, d, "events").withColumn("entity", F.pmod("user_id", F.lit(20)))
    f = e.where(F.col("event_type").isin("signup", "error")).select("entity", F.col("ts").alias("available_at"), "event_id", "value")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("point"), "entity", F.col("ts").alias("decision_time"))
    return asof_join(p, f, ["entity"], "decision_time", "available_at", ["event_id"], prefix="feature_").select("point", "feature_event_id", "feature_value")


BARS = """bars as (select ticker, date_trunc('hour', created_time) as hour, cast(sum(count) as bigint) as total_volume, cast(sum(case when taker_side = 'yes' then count else 0 end) as bigint) as yes_volume,
 arg_max(yes_price_cents, (created_time, trade_id)) as close_price, arg_max(yes_price_cents, (created_time, trade_id)) filter (taker_side = 'yes') as yes_close from trades group by all),
 shaped as (select *, case when count(*) over w >= 10 then quantile_cont(yes_volume, 0.5) over w end as prior_yes_median, yes_volume * 1.0 / total_volume as yes_share, yes_close - lag(close_price) over o as price_jump,
 date_diff('second', lag(hour) over o, hour) / 3600.0 as previous_gap_hours from bars window o as (partition by ticker order by hour), w as (partition by ticker order by hour rows between 20 preceding and 1 preceding))"""


def shaped(spark, d):
    return P.shock_features(P.bars(S.trades(spark, d).where("not is_block_trade")))


BLOCKLESS = S.TRADES.replace("from events)", "from events where event_type <> 'error')")


@query("a10_hourly_bars", f"with {BLOCKLESS}, {BARS} select * from bars")
def hourly(spark, d):
    return P.bars(S.trades(spark, d).where("not is_block_trade"))


@query("w03_rolling_median", f"with {BLOCKLESS}, {BARS} select ticker, hour, prior_yes_median, price_jump, previous_gap_hours, round(yes_share, 6) as yes_share from shaped")
def rolling_median(spark, d):
    return shaped(spark, d).select("ticker", "hour", "prior_yes_median", "price_jump", "previous_gap_hours", F.round("yes_share", 6).alias("yes_share"))


RULE = dict(volume=8, multiple=1.2, share=0.6, jump=2, gap_hours=48)
SHOCKS = f"""shocks as (select *, hour + interval 1 hour as signal_ts, yes_close as shock_price from shaped where prior_yes_median > 0 and yes_volume >= {RULE['volume']} and yes_volume >= {RULE['multiple']} * prior_yes_median
 and yes_share >= {RULE['share']} and price_jump >= {RULE['jump']} and previous_gap_hours <= {RULE['gap_hours']} qualify row_number() over (partition by ticker order by hour) = 1)"""


@query(
    "x12_flow_shocks",
    f"""with {BLOCKLESS}, {BARS}, {SHOCKS}, f as (select s.ticker, s.signal_ts, s.shock_price, s.yes_volume, h.hours, t.created_time as t, t.yes_price_cents as p from (select * from shocks, (values (24), (168)) x(hours)) s
    join (values (24), (168)) h(hours) on h.hours = s.hours asof left join trades t on s.ticker = t.ticker and s.signal_ts + to_hours(s.hours) >= t.created_time)
    select ticker, signal_ts, shock_price, yes_volume, max(case when hours = 24 and t > signal_ts then p - shock_price end) as change_24h, coalesce(max(case when hours = 168 and t > signal_ts then p - shock_price end), 0) as change_168h_zero,
    bool_or(hours = 24 and coalesce(t > signal_ts, false)) as has_followup_24h from f group by all""",
)
def shocks(spark, d):
    tape = S.trades(spark, d).where("not is_block_trade")
    s = P.select_shocks(shaped(spark, d), **RULE)
    near = tape.join(s.select("ticker"), "ticker", "left_semi")
    return P.forward_changes(s, near).select("ticker", "signal_ts", "shock_price", "yes_volume", "change_24h", "change_168h_zero", "has_followup_24h")


LADDER = f"""ladder as (select p.*, ticker as higher_ticker, lag(ticker) over w as lower_ticker, floor_strike as higher_strike, lag(floor_strike) over w as lower_strike, yes_price_cents - lag(yes_price_cents) over w as rise,
 lag(trade_time) over w as lower_trade_time from (select * from points qualify row_number() over (partition by event_ticker, label, decision_time, direction, floor_strike order by ticker) = 1) p window w as (partition by event_ticker, label, decision_time, direction order by floor_strike))"""


def ladder_frame(spark, d):
    extra = S.markets(spark, d).select("ticker", "floor_strike", "direction")
    return P.ladder_pairs(points(spark, d).join(extra, "ticker"))


@query(
    "w09_ladder_pairs",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {LADDER} select higher_ticker, lower_ticker, label as decision_label, case when direction = 'above' then rise else -rise end as signed_gap_cents,
    100 - case when direction = 'above' then rise else -rise end as pair_cost_cents, case when direction = 'above' then rise else -rise end >= 2 as violation_2c from ladder where lower_ticker is not null""",
)
def ladder(spark, d):
    return ladder_frame(spark, d).select("higher_ticker", "lower_ticker", "decision_label", "signed_gap_cents", "pair_cost_cents", "violation_2c")


@query(
    "x17_ladder_summary",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {LADDER}, g as (select *, case when direction = 'above' then rise else -rise end as gap from ladder where lower_ticker is not null)
    select direction, label as decision_label, count(*) as pairs, count(distinct event_ticker) as events, count(*) filter (gap >= 2) as violations, round(avg(case when gap >= 2 then 1.0 else 0 end), 6) as violation_rate, round(avg(gap), 6) as mean_gap, max(gap) as max_gap from g group by all""",
)
def ladder_summary(spark, d):
    g = ladder_frame(spark, d)
    v = F.col("violation_2c")
    return g.groupBy("direction", "decision_label").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("event_ticker").alias("events"), F.count_if(v).alias("violations"), F.round(F.avg(v.cast("double")), 6).alias("violation_rate"),
        F.round(F.avg("signed_gap_cents"), 6).alias("mean_gap"), F.max("signed_gap_cents").alias("max_gap"),
    )


GROUPS = """meta as (select ticker, event_ticker, case when event_ticker % 3 = 0 then 'Who will win ' || event_ticker when event_ticker % 3 = 1 then 'Which party ' || (ticker % 2) else 'A thing' end as title, 'c' || (ticker // case when event_ticker % 4 = 0 then 60 else 30 end) as yes_sub_title from markets),
 groups as (select event_ticker, count(*) as expected_contracts, count(*) >= 2 and count(distinct lower(title)) = 1 and count(distinct yes_sub_title) = count(*) and regexp_matches(min(lower(title)), '\\bwho will (win|be (the )?.*nominee|become)\\b|\\bwhich (party|candidate)\\b') as is_exclusive_group from meta group by event_ticker)"""


def exclusive(spark, d):
    m = S.markets(spark, d)
    e = F.col("event_ticker")
    k = F.pmod(e, F.lit(3))
    title = F.when(k == 0, F.concat(F.lit("Who will win "), e.cast("string"))).when(k == 1, F.concat(F.lit("Which party "), F.pmod("ticker", F.lit(2)).cast("string"))).otherwise("A thing")
    width = F.when(F.pmod(e, F.lit(4)) == 0, 60).otherwise(30)
    sub = F.concat(F.lit("c"), F.floor(F.col("ticker") / width).cast("string"))
    none = F.lit(None).cast("double")
    return P.exclusive_groups(m.select("ticker", "event_ticker", title.alias("title"), sub.alias("yes_sub_title"), none.alias("floor_strike"), none.alias("cap_strike")))


@query("a18_exclusive_groups", f"with {S.MARKETS}, {GROUPS} select event_ticker, expected_contracts, is_exclusive_group from groups")
def exclusive_groups(spark, d):
    return exclusive(spark, d)


@query(
    "x18_event_coherence",
    f"""with {S.TRADES}, {S.MARKETS}, {POINTS}, {GROUPS}, c as (select event_ticker, label as decision_label, count(*) as contracts, cast(sum(yes_price_cents) as bigint) as s from points join groups using (event_ticker) where is_exclusive_group group by event_ticker, label, decision_time having count(*) >= 2 and count(*) = max(expected_contracts))
    select event_ticker, decision_label, contracts, s as yes_price_sum_cents, abs(s - 100) as dislocation_cents, case when s > 100 then 'buy_all_no' else 'buy_all_yes' end as dislocation_side, round(abs(s - 100) * 1.0 / case when s > 100 then 100 * contracts - s else s end, 6) as proxy from c""",
)
def coherence(spark, d):
    # Decisions share a time only where an event's contracts share their close; the day is the group here.
    df = P.event_coherence(points(spark, d).join(exclusive(spark, d), "event_ticker"))
    return df.select("event_ticker", "decision_label", "contracts", "yes_price_sum_cents", "dislocation_cents", "dislocation_side", F.round("multi_leg_return_proxy", 6).alias("proxy"))


@query(
    "j21_order_prints",
    f"""with {S.TRADES}, o as (select trade_id, ticker, yes_price_cents, created_time from trades where is_block_trade)
    select o.trade_id as order_id, cast(coalesce(sum(t.count), 0) as bigint) as printed from o left join trades t on t.ticker = o.ticker and t.taker_side = 'yes' and t.created_time >= o.created_time and t.yes_price_cents <= o.yes_price_cents group by o.trade_id""",
)
def order_prints(spark, d):
    """What was bought since each order at its price or below."""
    t = S.trades(spark, d)
    orders = t.where("is_block_trade").select(F.col("trade_id").alias("order_id"), "ticker", "yes_price_cents", "created_time")
    yes = t.where("taker_side = 'yes'")
    got = dominance_sums(orders, yes, ["ticker"], "created_time", "created_time", F.col("yes_price_cents"), F.col("yes_price_cents"), F.col("count"), "printed")
    return got.select("order_id", "printed")


@query(
    "x24_paper_orders",
    f"""with {S.TRADES}, {S.MARKETS}, o as (select trade_id as order_id, ticker, 100 - yes_price_cents as price_c, 5 + trade_id % 50 as qty, created_time as placed_ts from trades where is_block_trade),
    f as (select o.order_id, o.ticker, o.price_c, o.qty, least(o.qty, cast(floor(0.5 * coalesce(sum(t.count), 0)) as bigint)) as filled_qty from o left join trades t on t.ticker = o.ticker and t.taker_side = 'yes' and t.created_time >= o.placed_ts and t.yes_price_cents <= 100 - o.price_c group by o.order_id, o.ticker, o.price_c, o.qty)
    select order_id, filled_qty, case when settled_time is not null then 'settled' when filled_qty <= 0 then 'resting' when filled_qty < qty then 'partial' else 'filled' end as state,
    case when settled_time is not null then round(filled_qty * ((case when result = 'no' then 100 else 0 end) - price_c) / 100.0, 2) else 0 end as realized_usd from f join markets using (ticker)""",
)
def paper_orders(spark, d):
    t = S.trades(spark, d)
    orders = t.where("is_block_trade").select(F.col("trade_id").alias("order_id"), "ticker", (100 - F.col("yes_price_cents")).alias("price_c"), (5 + F.pmod("trade_id", F.lit(50))).alias("qty"), F.col("created_time").alias("placed_ts"))
    m = S.markets(spark, d).select("ticker", F.when(F.col("settled_time").isNotNull(), F.col("result")).alias("result"))
    return P.settle_orders(P.paper_fills(orders, t), m).select("order_id", "filled_qty", "state", "realized_usd")


@query(
    "a20_book_capacity",
    """with b as (select user_id as ticker, date_trunc('day', ts) as day, list([1 + cast(floor(value) as bigint) % 99, 1 + event_id % 30] order by event_id) as no from events group by all),
    l as (select ticker, arg_max(no, day) as no from b group by ticker) select ticker, no[-1][1] as best_no_cents, round(list_sum(list_transform(no[-3:], lambda x: x[1] * x[2] / 100.0)), 6) as capacity_usd from l""",
)
def capacity(spark, d):
    e = S.table(spark, d, "events")
    level = F.struct("event_id", F.array((1 + F.pmod(F.floor("value").cast("long"), F.lit(99))).cast("string"), (1 + F.pmod("event_id", F.lit(30))).cast("string")).alias("l"))
    books = e.groupBy(F.col("user_id").alias("ticker"), F.date_trunc("day", "ts").alias("ts")).agg(F.transform(F.sort_array(F.collect_list(level)), lambda x: x["l"]).alias("no"))
    return P.book_capacity(books).select("ticker", "best_no_cents", F.round("capacity_usd", 6).alias("capacity_usd"))


@query(
    "w10_running_extremes",
    "select event_id, max(value) over w as max_so_far, min(value) over w as min_so_far from events window w as (partition by user_id % 20, cast(ts as date) order by ts, event_id rows unbounded preceding)",
)
def running_extremes(spark, d):
    w = Window.partitionBy(F.pmod("user_id", F.lit(20)), F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return S.table(spark, d, "events").select("event_id", F.max("value").over(w).alias("max_so_far"), F.min("value").over(w).alias("min_so_far"))
