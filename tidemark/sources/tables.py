"""The given tables seen as trades, contracts and what else the operators take.

Every view is a plain projection of ``events``, ``orders``, ``lineitem`` or
``documents``, so its rows grow with them; the SQL texts say the same for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.economics import MAKER_FEES, div

# Fold and period bounds for the tables' month of events.
FOLDS = (("early", "2024-01-11"), ("middle", "2024-01-21"), ("recent", "2024-01-29"), ("forward", None))
SPLIT = (("discovery", "2024-01-16"), ("confirmation", None))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return trades_of(table(spark, d, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    """Events, landed or streamed, as trades."""
    return events.select(
        F.col("event_id").alias("trade_id"),
        F.col("user_id").alias("ticker"),
        F.col("ts").alias("created_time"),
        (1 + F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(99))).cast("long").alias("yes_price_cents"),
        (1 + F.pmod(F.col("event_id"), F.lit(20))).cast("long").alias("count"),
        F.when(F.col("event_type").isin("view", "click"), "yes").otherwise("no").alias("taker_side"),
        (F.col("event_type") == "error").alias("is_block_trade"),
    )


TRADES = """trades as (select event_id as trade_id, user_id as ticker, ts as created_time,
 cast(1 + cast(floor(value * 100) as bigint) % 99 as bigint) as yes_price_cents, cast(1 + event_id % 20 as bigint) as count,
 case when event_type in ('view', 'click') then 'yes' else 'no' end as taker_side, event_type = 'error' as is_block_trade from events)"""


def markets(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("ticker")
    base = table(spark, d, "events").groupBy(F.col("user_id").alias("ticker")).agg((F.count(F.lit(1))).cast("double").alias("volume"))
    start, end = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz")
    close = end - F.make_dt_interval(F.pmod(u, F.lit(7)).cast("int"))
    return base.select(
        "ticker", F.pmod(u, F.lit(30)).alias("event_ticker"), F.pmod(u, F.lit(10)).alias("series_ticker"), F.pmod(u, F.lit(5)).alias("category"),
        F.when(F.pmod(u, F.lit(4)) == 0, MAKER_FEES).otherwise("quadratic").alias("fee_type"), F.when(F.pmod(u * 7, F.lit(10)) < 3, "yes").otherwise("no").alias("result"),
        (start + F.make_dt_interval(F.pmod(u, F.lit(10)).cast("int"))).alias("open_time"), close.alias("close_time"), close.alias("expiration_time"),
        F.when(F.pmod(u, F.lit(6)) != 0, close + F.make_dt_interval(F.lit(0), F.pmod(u, F.lit(3)).cast("int"))).alias("settled_time"),
        (F.pmod(u, F.lit(3)) == 0).alias("can_close_early"), "volume", div(u, 30).cast("double").alias("floor_strike"),
        F.when(F.pmod(F.pmod(u, F.lit(30)), F.lit(2)) == 0, "above").otherwise("below").alias("direction"),
    )


MARKETS = f"""markets as (select ticker, ticker % 30 as event_ticker, ticker % 10 as series_ticker, ticker % 5 as category,
 case when ticker % 4 = 0 then '{MAKER_FEES}' else 'quadratic' end as fee_type, case when (ticker * 7) % 10 < 3 then 'yes' else 'no' end as result,
 timestamp '2024-01-01' + to_days(cast(ticker % 10 as integer)) as open_time, close_time, close_time as expiration_time,
 case when ticker % 6 <> 0 then close_time + to_hours(ticker % 3) end as settled_time, ticker % 3 = 0 as can_close_early, volume,
 cast(ticker // 30 as double) as floor_strike, case when (ticker % 30) % 2 = 0 then 'above' else 'below' end as direction
 from (select user_id as ticker, timestamp '2024-01-31' - to_days(cast(user_id % 7 as integer)) as close_time, cast(count(*) as double) as volume from events group by user_id))"""


def fills(spark: SparkSession, d: str) -> DataFrame:
    """Line items as fills: the order's customer is the event, the part the contract."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    df = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    p = (1 + F.pmod(F.floor(F.col("l_extendedprice")).cast("long"), F.lit(99))).cast("long")
    return df.select(
        F.col("l_partkey").alias("ticker"), F.pmod("o_custkey", F.lit(200)).alias("event_ticker"), F.pmod("l_suppkey", F.lit(6)).alias("category"), p.alias("yes_price_cents"),
        F.col("l_quantity").cast("double").alias("count"), F.when(F.col("l_returnflag") == "N", "yes").otherwise("no").alias("taker_side"),
        F.when(F.pmod("l_partkey", F.lit(4)) == 0, MAKER_FEES).otherwise("quadratic").alias("fee_type"), (F.pmod(F.col("l_partkey") * 7, F.lit(10)) < 3).cast("long").alias("result_yes"),
        F.col("l_shipdate").alias("created_time"), (1 + F.pmod("l_orderkey", F.lit(300))).cast("long").alias("horizon_days"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "discovery").otherwise("confirmation").alias("period"),
    )


FILLS = f"""fills as (select l_partkey as ticker, o_custkey % 200 as event_ticker, l_suppkey % 6 as category, cast(1 + cast(floor(l_extendedprice) as bigint) % 99 as bigint) as yes_price_cents,
 cast(l_quantity as double) as count, case when l_returnflag = 'N' then 'yes' else 'no' end as taker_side, case when l_partkey % 4 = 0 then '{MAKER_FEES}' else 'quadratic' end as fee_type,
 cast(case when (l_partkey * 7) % 10 < 3 then 1 else 0 end as bigint) as result_yes, l_shipdate as created_time, cast(1 + l_orderkey % 300 as bigint) as horizon_days,
 case when o_orderkey % 2 = 0 then 'discovery' else 'confirmation' end as period from lineitem join orders on l_orderkey = o_orderkey)"""
