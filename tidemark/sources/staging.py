"""Where tables written between steps go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.landed import overwrite

_own: dict[str, str] = {}
_STATES = "spark.sql.streaming.stateStore.providerClass"


def new_folder(spark: SparkSession) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``; where it is unset and all tasks run on this machine, below one of our own."""
    conf, context = spark.sparkContext.getConf(), spark.sparkContext
    found = conf.get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = found or _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-landing-')}")
    return f"{root}/{context.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read again: what follows doesn't depend on the executors that made it."""
    path = f"{new_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that has landed: in complete mode the last batch, else all batches."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    path = f"{folder}/rows"

    def keep(batch, _):
        if mode == "complete":
            overwrite(batch, path)
        else:
            batch.write.mode("append").parquet(path)

    before = spark.conf.get(_STATES)
    spark.conf.set(_STATES, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one for processors with state
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STATES, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
