"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.sources import store
from tidemark.sources.landed import merge_partition, store_features


def incremental_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str, partition: str | None = None):
    """Landed rows upserted into ``path``; the checkpoint is the high-water mark.

    The merge is idempotent by key, so rows may come again and as late as they
    like. With ``partition``, a batch rewrites only the partitions it touches.
    """
    sink = lambda df, _: merge_partition(df, path, keys, [F.desc(ts)], partition)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str, partition: Column, overlap: str = "48 hours", name: str = "ingest"):
    """Rows with event times that land in overlapping pieces, each once, into a ``store`` by ``partition`` (a function of ``keys``).

    The watermark stays ``overlap`` behind the newest time: a row that comes again
    or late within it is recognised or still taken, an older one is not (it has
    been taken, as every piece reaches ``overlap`` back); state is dropped behind
    it. A batch that is run again after a crash has been merged or not, by its
    number in the store, and the merge goes by key, so each row is there once.
    """
    once = stream.withWatermark(ts, overlap).dropDuplicatesWithinWatermark(keys)
    sink = lambda df, batch: store.merge(df, path, keys, [F.desc(ts)], partition, name, batch)
    return once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunked_flush(stream: DataFrame, path: str, checkpoint: str, keys: list[str], rows_per_file: int = 100_000):
    """Landed files flushed in chunks: a micro-batch (its size is the source's ``maxFilesPerTrigger``) becomes one folder of bounded files.

    The checkpoint's commit log is the list of what is done: a run that was
    killed goes on with the batch that it lacks, over the same files, and writes
    its folder anew. Within a batch each key is kept once. Read with ``flushed``.
    """

    def flush(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/chunk-{n:08d}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flushed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The chunks of ``chunked_flush`` that are whole; one that a killed run left unfinished has no mark and is left out."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    chunks = [c.getPath() for c in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = sorted(c.toString() for c in chunks if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(c, "_SUCCESS")))
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def latest_books(stream: DataFrame) -> DataFrame:
    """The newest book of each ticker (update mode)."""
    return stream.groupBy("ticker").agg(F.max_by(F.struct("ts", "yes", "no"), "ts").alias("book")).select("ticker", "book.*")


def hourly_bars(trades: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly bars with a watermark (append mode); equal to the batch bars for rows within it."""
    yes = F.col("taker_side") == "yes"
    order = F.struct("created_time", "trade_id")
    g = trades.withWatermark("created_time", late).groupBy(F.window("created_time", "1 hour"), "ticker")
    agg = g.agg(
        F.sum("count").alias("total_volume"),
        F.sum(F.when(yes, F.col("count")).otherwise(0)).alias("yes_volume"),
        F.max_by("yes_price_cents", order).alias("close_price"),
        F.max_by(F.when(yes, F.col("yes_price_cents")), F.when(yes, order)).alias("yes_close"),
    )
    return agg.select("ticker", F.col("window.start").alias("hour"), "total_volume", "yes_volume", "close_price", "yes_close")


class ShockDetector(StatefulProcessor):
    """Keeps the last bars of a ticker and whether it has fired; later batches must bring later bars, as ``hourly_bars`` does."""

    def __init__(self, prior: int = 20, least: int = 10, volume: float = 200, multiple: float = 5, share: float = 0.7, jump: float = 2, gap_hours: float = 24):
        self.p = (prior, least, volume, multiple, share, jump, gap_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", "volumes array<double>, close double, hour timestamp, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prior, least, volume, multiple, share, jump, gap_hours = self.p
        s = self.state.get() if self.state.exists() else None
        volumes, close, hour, fired = (list(s[0]), s[1], s[2], s[3]) if s else ([], None, None, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("hour").itertuples():
            if not fired and len(volumes) >= least and close is not None and r.yes_close == r.yes_close and r.yes_close is not None:
                median = float(np.median(volumes[-prior:]))
                gap = (r.hour - pd.Timestamp(hour)).total_seconds() / 3600
                if median > 0 and r.yes_volume >= volume and r.yes_volume >= multiple * median and r.yes_volume >= share * r.total_volume and r.yes_close - close >= jump and gap <= gap_hours:
                    fired = True
                    out.append({"ticker": key[0], "hour": r.hour, "shock_price": float(r.yes_close), "yes_volume": float(r.yes_volume), "prior_yes_median": median})
            volumes = (volumes + [float(r.yes_volume)])[-prior:]
            close, hour = float(r.close_price), r.hour
        self.state.update((volumes, close, hour, fired))
        yield pd.DataFrame(out, columns=["ticker", "hour", "shock_price", "yes_volume", "prior_yes_median"])

    def close(self) -> None:
        pass


def shocks(bars: DataFrame, detector: ShockDetector | None = None) -> DataFrame:
    """First shock of each ticker from a stream of bars (needs the RocksDB state store)."""
    kind = bars.schema["ticker"].dataType.simpleString()
    return bars.groupBy("ticker").transformWithStateInPandas(detector or ShockDetector(), f"ticker {kind}, hour timestamp, shock_price double, yes_volume double, prior_yes_median double", "Append", "None")


def tape_shocks(trades: DataFrame, late: str = "1 hour", detector: ShockDetector | None = None) -> DataFrame:
    """Shocks straight from the tape: two stateful operators in one stream.

    In append mode the bars of an hour leave the first when the watermark has
    passed it, whatever order the trades came in, so the second gets each
    ticker's bars in order and needs no timer of its own.
    """
    return shocks(hourly_bars(trades, late), detector)


def running_extremes(readings: DataFrame) -> DataFrame:
    """Daily maximum and minimum so far of each station (update mode); known an hour after the last reading."""
    g = readings.groupBy("station", F.to_date("local_time").alias("local_date"))
    return g.agg(F.max("value").alias("max_so_far"), F.min("value").alias("min_so_far"), (F.max("ts") + F.expr("interval 1 hour")).alias("available_at"))


def feature_append(stream: DataFrame, path: str, checkpoint: str, name: str = "features"):
    """Point-in-time features, idempotent by key; a row lands however late it is, without changing past decisions. Only the months of a batch are written."""
    sink = lambda df, batch: store_features(df, path, name, batch)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
