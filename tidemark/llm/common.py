"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAKS = " \t\n\x0b\x0c\r"

_staged: dict[str, list[str]] = {}
_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all tasks run on this machine, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-stage-')}")


def _remove(spark: SparkSession, app: str) -> None:
    try:
        for path in _staged.pop(app, []):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clear
        pass


def row_tie() -> Column:
    """A number of its own for each row of a written table, the same whenever it is read: equal rows spread over ranges by it."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def drop_stage(df: DataFrame) -> None:
    """Deletes a table written by ``stage`` that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_stage_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    This cuts lineage and survives the loss of any executor. Shuffle files of
    the write are freed when it ends; the tables of an application are deleted
    when its Python driver ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if app not in _staged:
        _staged[app] = []
        atexit.register(_remove, spark, app)
    _staged[app].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


#: Keys that ``join_dealt`` may take for hot, and rows that never make a key hot.
HOT_KEYS, NEVER_HOT = 2000, 1000


def join_dealt(rows: DataFrame, side: DataFrame, keys: list[str], by: str, many: str = "n") -> DataFrame:
    """``rows`` joined with ``side`` (written; one row a key), whose column ``many`` counts the rows of the key.

    A key with more than one in ``HOT_KEYS`` of all rows is dealt over several
    tasks by a hash of the column ``by``. There are fewer than ``HOT_KEYS`` of
    these, whatever the tables hold, so they are broadcast.
    """
    share = max(NEVER_HOT, (side.agg(F.sum(many)).first()[0] or 0) // HOT_KEYS)
    deals = F.ceil(F.col(many) / F.lit(share)).cast("int")
    hot = side.where(F.col(many) > share).select(*keys, deals.alias("_deals"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(by), F.col("_deals")), F.lit(0)).cast("int")).drop("_deals")
    copies = side.withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    return dealt.join(copies, [*keys, "_deal"]).drop("_deal")


def rows_per_batch(spark: SparkSession, n: int = 512) -> None:
    """Bounds the Arrow batches of Python stages over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(batch, text_column: int, limit: int = 4 << 20):
    """Splits an Arrow batch so that each part holds about ``limit`` bytes of text (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a column of texts (null: none): each word's place among the distinct words, words per text, the distinct words."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    lens = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(flat.dictionary, "").as_py() if len(flat.dictionary) else -1
    if empty >= 0:  # left by white space at the ends of a text
        real = codes != empty
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[real], minlength=len(lens))
        codes = codes[real]
    return codes, lens, flat.dictionary


def listed(words: pa.Array) -> list[str]:
    """Words without spaces as a list: one string joined and split again is read faster than single values."""
    ends = pa.array([0, len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, words), " ")[0].as_py().split(" ") if len(words) else []


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``coded`` with the distinct words as a list."""
    codes, lens, words = coded(texts)
    return codes, lens, listed(words)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit numbers over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the runs (start, count), one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def hidden_names(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names that clash with nothing, and the columns that give the caller's names back."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), [F.col(o).alias(c) for o, c in zip(own, docs.columns)]


_word_caches: dict[str, object] = {}


def only_word_cache(name: str, clear) -> None:
    """A worker process serves many stages: of their word caches, only the latest stage's stays in memory."""
    for other in [n for n in _word_caches if n != name]:
        _word_caches.pop(other)()
    _word_caches[name] = clear
