"""Queries of what lands: shards, merged partitions, features, exported state, and the streaming jobs over all landed rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import query
from tidemark.sources import landed as D
from tidemark.plans.panels import BARS, BLOCKLESS, RULE, SHOCKS
from tidemark.sources import store
from tidemark.sources import tables as S
from tidemark.sources.staging import drained, new_folder
from tidemark.streaming import jobs


def stream(spark, d: str, name: str) -> DataFrame:
    """The given table as a stream of its files, be it a folder or one file of ``d``."""
    schema = S.table(spark, d, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("s02_shards", "select l_orderkey, l_linenumber, cast(l_partkey as double) as l_partkey, cast(null as varchar) as l_note from lineitem where l_quantity > 45")
def shards(spark, d):
    """A projection of the shards under a declared schema: types are promoted, a column that no shard has is null."""
    kinds = "l_orderkey long, l_linenumber int, l_partkey double, l_quantity double, l_note string"
    got = D.read_shards(spark, [f"{d}/lineitem.parquet"], T.StructType.fromDDL(kinds))
    return got.where("l_quantity > 45").drop("l_quantity")


@query(
    "s15_merged_partitions",
    "select o_orderkey, year(o_orderdate) as year, case when o_orderkey % 3 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from (select distinct o_orderkey, o_orderdate, max(o_totalprice) over (partition by o_orderkey, year(o_orderdate)) as o_totalprice from orders) group by all",
)
def merged(spark, d):
    """Orders landed once and then a third of them again with other prices: the newer rows win, by year."""
    path = f"{new_folder(spark)}/orders"
    o = S.table(spark, d, "orders").groupBy("o_orderkey", F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("o_totalprice")).withColumn("landed", F.lit(1))
    D.merge_partition(o, path, ["o_orderkey", "year"], [F.desc("landed")], "year")
    again = o.where("o_orderkey % 3 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "landed": F.lit(2)})
    return D.merge_partition(again, path, ["o_orderkey", "year"], [F.desc("landed")], "year").drop("landed")


def _features(events: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "ts")
    return events.select(
        F.lit("events").alias("source"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("metric"), day.alias("effective_at"), day.alias("available_at"),
        F.col("ts").alias("retrieved_at"), F.col("event_id").cast("string").alias("value"), F.lit("r1").alias("revision"), F.lit("").alias("evidence"),
    )


_LAST_FEATURES = "select cast(user_id as varchar) as entity, event_type as metric, cast(cast(ts as date) as timestamp) as available_at, arg_max(cast(event_id as varchar), (ts, cast(event_id as varchar))) as value from events group by all"


@query("s17_feature_partitions", _LAST_FEATURES)
def feature_partitions(spark, d):
    """Features written in two overlapping parts: writing again what is there changes nothing."""
    path, e = f"{new_folder(spark)}/features", S.table(spark, d, "events")
    D.store_features(_features(e.where("event_id % 3 <> 0")), path)
    return D.store_features(_features(e.where("event_id % 2 <> 0 or event_id % 3 = 0")), path).select("entity", "metric", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "value")


@query(
    "s13_s19_book_history",
    "select cast(user_id as varchar) as ticker, cast(event_id as varchar) as ts, cast(value as varchar) as best, cast(event_id % 7 as varchar) as size, event_id % 3 > 0 as has_no from events",
)
def book_history(spark, d):
    """Books of every event appended to a history of JSON lines in two goes and read back by the capture source."""
    path = f"{new_folder(spark)}/books"
    text = lambda c: F.col(c).cast("string")
    level = F.array(F.array(text("value"), F.pmod("event_id", F.lit(7)).cast("string")))
    none = F.array().cast("array<array<string>>")
    books = S.table(spark, d, "events").select(text("event_id").alias("ts"), text("user_id").alias("ticker"), level.alias("yes"), F.when(F.pmod("event_id", F.lit(3)) > 0, level).otherwise(none).alias("no"), F.pmod("event_id", F.lit(2)).alias("half"))
    for half in (0, 1):
        D.append_history(books.where(F.col("half") == half).drop("half"), path)
    got = D.book_capture(spark, path)
    return got.select("ticker", "ts", F.col("yes")[0][0].alias("best"), F.col("yes")[0][1].alias("size"), (F.size("no") > 0).alias("has_no"))


@query("s21_content_fingerprint")
def fingerprints(spark, d):
    """One digest of the bytes of each given table. (SQL sees no files; a test changes one.)"""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    each = [D.fingerprint(spark, f"{d}/{n}.parquet").select(F.lit(n).alias("table"), "sha256", "files") for n in names]
    return reduce(DataFrame.unionByName, each)


@query("s18_chunked_flush", "select event_id, user_id, value from events")
def chunks(spark, d):
    """Events landed in several files, two a micro-batch, flushed in files of at most 5,000 rows."""
    folder = new_folder(spark)
    e = S.table(spark, d, "events").select("event_id", "user_id", "value")
    e.repartition(5).write.parquet(f"{folder}/landed")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/landed")
    jobs.chunked_flush(rows, f"{folder}/chunks", f"{folder}/log", ["event_id"], 5000).awaitTermination()
    return jobs.flushed(spark, f"{folder}/chunks", e.schema)


@query("s20_state_export", "select c_custkey, c_name, case when c_acctbal > 0 then c_acctbal end as c_acctbal from customer")
def state_export(spark, d):
    path = f"{new_folder(spark)}/state"
    D.export_state(S.table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal")), path)
    return D.import_state(spark, path)


@query("r01_incremental_upsert", "select o_orderkey, max(o_orderdate) as o_orderdate from orders group by o_orderkey")
def upsert(spark, d):
    """Orders landed in three pieces, each reaching 48 hours back and the second with rows that the first lacked, ingested as they land."""
    orders = S.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    low, high = orders.agg(F.min("at"), F.max("at")).first()
    third, back = (high - low) / 3, dt.timedelta(hours=48)
    first, second = low + third, low + 2 * third
    late = (F.col("at") >= F.lit(first - back)) & (F.pmod("o_orderkey", F.lit(5)) == 0)
    pieces = [orders.where((F.col("at") < F.lit(first)) & ~late), orders.where((F.col("at") >= F.lit(first - back)) & (F.col("at") < F.lit(second))), orders.where(F.col("at") >= F.lit(second - back))]
    folder = new_folder(spark)
    for piece in pieces:
        piece.write.mode("append").parquet(f"{folder}/landed")
        rows = spark.readStream.schema(orders.schema).parquet(f"{folder}/landed")
        jobs.incremental_ingest(rows, f"{folder}/orders", f"{folder}/log", ["o_orderkey", "at"], "at", F.date_format("at", "yyyy-MM")).awaitTermination()
    kind = S.table(spark, d, "orders").schema["o_orderdate"].dataType
    return store.read(spark, f"{folder}/orders").select("o_orderkey", F.col("at").cast(kind).alias("o_orderdate"))


@query("r02_latest_books", "select cast(user_id as varchar) as ticker, max(cast(event_id as varchar)) as ts from events group by 1")
def books(spark, d):
    e = stream(spark, d, "events")
    level = F.array(F.array(F.col("value").cast("string"), F.lit("1")))
    got = jobs.latest_books(e.select(F.col("user_id").cast("string").alias("ticker"), F.col("event_id").cast("string").alias("ts"), level.alias("yes"), level.alias("no")))
    return drained(got).select("ticker", "ts")


@query("r05_running_extremes", "select user_id % 20 as station, cast(cast(ts as date) as varchar) as local_date, max(value) as max_so_far, min(value) as min_so_far from events group by all")
def extremes(spark, d):
    e = stream(spark, d, "events").select(F.pmod("user_id", F.lit(20)).alias("station"), F.col("ts").alias("local_time"), "ts", "value")
    return drained(jobs.running_extremes(e)).select("station", F.col("local_date").cast("string").alias("local_date"), "max_so_far", "min_so_far")


@query("r06_feature_append", _LAST_FEATURES)
def feature_append(spark, d):
    path, log = f"{new_folder(spark)}/features", f"{new_folder(spark)}/log"
    e = stream(spark, d, "events")
    jobs.feature_append(_features(e), path, log).awaitTermination()
    return store.read(spark, path).select("entity", "metric", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "value")


@query(
    "r03_streamed_bars",
    """with b as (select user_id as ticker, date_trunc('hour', ts) as hour, cast(sum(1 + event_id % 20) as bigint) as total_volume, cast(sum(case when event_type in ('view', 'click') then 1 + event_id % 20 else 0 end) as bigint) as yes_volume from events group by all),
    m as (select max(ts) as top from events) select ticker, hour, total_volume, yes_volume from b, m where hour + interval 1 hour <= top - interval 1 hour""",
)
def streamed_bars(spark, d):
    """Bars of the hours that the watermark has closed."""
    t = S.trades_of(stream(spark, d, "events")).withColumn("created_time", F.col("created_time").cast("timestamp"))
    return drained(jobs.hourly_bars(t), "append").select("ticker", F.col("hour").cast("timestamp_ntz").alias("hour"), "total_volume", "yes_volume")


@query(
    "r04_streamed_shocks",
    f"""with {BLOCKLESS}, {BARS}, {SHOCKS}, m as (select max(created_time) as top from trades)
    select ticker, hour, cast(yes_close as double) as shock_price, cast(yes_volume as double) as yes_volume, prior_yes_median from shocks, m where hour + interval 1 hour <= top - interval 1 hour""",
)
def streamed_shocks(spark, d):
    """The first shock of each ticker, found by the stream itself from the trades, in the hours that the watermark has closed."""
    t = S.trades_of(stream(spark, d, "events")).where("not is_block_trade").withColumn("created_time", F.col("created_time").cast("timestamp"))
    got = drained(jobs.tape_shocks(t, detector=jobs.ShockDetector(**RULE)), "append")
    return got.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
