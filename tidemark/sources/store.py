"""Partitioned tables whose state is one manifest: new part files, then one new version that names them.

Below the table's path, ``data/<write>/_part=<value>`` holds part files that are
never changed, and ``_versions/<number>.json`` names the folder of each partition.
A merge writes new folders for the partitions it touches and then one version, so
a reader sees the table before the merge or after it, whatever number of
partitions it spans, and a writer that dies leaves the old version in place. A
version file that was not finished does not parse and counts as never written.

One writer at a time is meant; a version that another writer makes in between is
noticed and the merge is done again on top of it.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import pick

VERSIONS, DATA, PART = "_versions", "data", "_part"


class Version(NamedTuple):
    """``parts``: partition -> folder below the table; ``done``: source -> its last merged batch."""

    number: int
    parts: dict[str, str]
    done: dict[str, int]
    schema: str | None


EMPTY = Version(0, {}, {}, None)


class Conflict(RuntimeError):
    """Another writer has made the version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/{VERSIONS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _version_path(path: str, number: int) -> str:
    return f"{path}/{VERSIONS}/{number:020d}.json"


def _read_version(spark: SparkSession, path: str, number: int) -> Version | None:
    fs, p = _fs(spark, _version_path(path, number))
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Version(number, **json.loads(text))
    except (ValueError, TypeError):
        return None


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest whole version (number 0: no table), or the whole version ``number``."""
    numbers = [number] if number else reversed(_numbers(spark, path))
    for n in numbers:
        found = _read_version(spark, path, n)
        if found:
            return found
    if number:
        raise ValueError(f"{path} has no version {number}")
    return EMPTY


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Makes ``version`` the newest; ``Conflict`` if its number is taken."""
    fs, p = _fs(spark, _version_path(path, version.number))
    data = json.dumps({k: v for k, v in version._asdict().items() if k != "number"}, sort_keys=True)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"version {version.number} of {path} is taken") from e
        raise
    try:
        out.write(bytearray(data.encode()))
    finally:
        out.close()


def part_name(value: Column) -> Column:
    """A folder's name for a partition value; null has one too."""
    safe = F.regexp_replace(F.regexp_replace(F.url_encode(value.cast("string")), "%", "~"), r"\*", "~2A")
    return F.coalesce(safe, F.lit("~"))


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, parts: list[str] | None = None, number: int | None = None) -> DataFrame:
    """The table as of its newest version or of ``number``; only the partitions ``parts`` (as ``part_name`` has them) if given."""
    v = current(spark, path, number)
    schema = schema or (T.StructType.fromJson(json.loads(v.schema)) if v.schema else None)
    if schema is None:
        raise FileNotFoundError(f"no table at {path}")
    folders = sorted(f"{path}/{f}" for p, f in v.parts.items() if parts is None or p in parts)
    return spark.read.schema(schema).parquet(*folders).select(*[F.col(f"`{c}`") for c in schema.names]) if folders else spark.createDataFrame([], schema)


def write_parts(rows: DataFrame, path: str) -> dict[str, str]:
    """Writes rows with a column ``_part`` to a new folder: partition -> its folder. Large partitions become many files."""
    spark, name = rows.sparkSession, f"{DATA}/{uuid.uuid4().hex}"
    rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/{name}")
    fs, p = _fs(spark, f"{path}/{name}")
    folders = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return {f.partition("=")[2]: f"{name}/{f}" for f in folders if f.startswith(f"{PART}=")}


def merge(new: DataFrame, path: str, keys: list[str], order: list[Column], partition: Column, source: str = "", batch: int | None = None, attempts: int = 5) -> DataFrame:
    """Upserts ``new``: the last row of each key by ``order`` stays, a new row before a stored equal.

    ``partition`` must follow from the keys. Only touched partitions are read and
    written anew; all others keep their files. A ``batch`` of ``source`` that has
    been merged already changes nothing, as does merging the same rows again.
    """
    spark = new.sparkSession
    if batch is not None and current(spark, path).done.get(source, -1) >= batch:
        return read(spark, path, new.schema)
    staged = f"{path}/{DATA}/{uuid.uuid4().hex}"  # evaluated once, whatever ``new`` is
    new.withColumn(PART, part_name(partition)).write.parquet(staged)
    rows = spark.read.schema(T.StructType(list(new.schema.fields)).add(PART, T.StringType())).parquet(staged)
    touched = [r[0] for r in rows.select(PART).distinct().collect()]  # folders to write
    try:
        for _ in range(attempts):
            old = current(spark, path)
            if batch is not None and old.done.get(source, -1) >= batch:
                break
            stored = read(spark, path, new.schema, touched) if touched else spark.createDataFrame([], new.schema)
            both = stored.withColumn(PART, part_name(partition)).withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
            merged = pick(both, [*keys, PART], [*order, F.desc("_new")]).drop("_new")
            parts = write_parts(merged, path) if touched else {}
            done = old.done | ({source: batch} if batch is not None else {})
            number = max([old.number, *_numbers(spark, path)]) + 1
            try:
                publish(spark, path, Version(number, old.parts | parts, done, new.schema.json()))
                break
            except Conflict:
                time.sleep(0.2)
        else:
            raise Conflict(f"{path} changed {attempts} times during a merge")
    finally:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)
    return read(spark, path, new.schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes what none of the newest ``keep`` whole versions names, and older versions; returns how many folders went.

    No reader of an older version and no writer may be at work.
    """
    whole = [v for v in (_read_version(spark, path, n) for n in reversed(_numbers(spark, path))) if v][:keep]
    if not whole:
        return 0
    used, gone = {f for v in whole for f in v.parts.values()}, 0
    fs, p = _fs(spark, f"{path}/{DATA}")
    for write in fs.listStatus(p) if fs.exists(p) else []:
        for folder in fs.listStatus(write.getPath()):
            name = f"{DATA}/{write.getPath().getName()}/{folder.getPath().getName()}"
            if folder.isDirectory() and name not in used:
                fs.delete(folder.getPath(), True)
                gone += 1
    for n in _numbers(spark, path):
        if n < whole[-1].number:
            fs.delete(_fs(spark, _version_path(path, n))[1], False)
    return gone
