"""Tables built from other tables, each kept under a digest of all that went into it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Step(NamedTuple):
    """``build`` gets the tables named in ``needs``; ``params`` and ``version`` stand for all else that it depends on."""

    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    params: dict = {}
    version: int = 1


class Built(NamedTuple):
    table: DataFrame
    digest: str
    path: str
    fresh: bool


def rows_digest(df: DataFrame) -> str:
    """A digest of the rows and schema of a table, whatever their order and files: two sums of hashes, one pass, nothing gathered."""
    whole = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    sums = [F.sum(F.xxhash64(F.lit(seed), whole).cast("decimal(38,0)")) for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(json.dumps([kinds, *map(str, row)]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rebuild(spark: SparkSession, root: str, sources: dict[str, DataFrame], steps: dict[str, Step], missing: DataFrame | None = None) -> dict[str, Built]:
    """Builds every step whose inputs, parameters or version changed since any earlier run; returns all steps.

    A step is kept in ``root/<step>/<digest>``, where the digest is over its
    name, parameters, version and the digests of what it needs: rows for a source,
    all the way down for a step. So a changed source rebuilds its heirs and
    nothing else, and going back to an earlier state finds the earlier tables.
    Spark marks a table when all of it is written; one that a killed run left
    unfinished has no mark and is built again.

    ``missing`` are keys still to be landed: while there are any, nothing is built.
    """
    if missing is not None and not missing.isEmpty():
        raise RuntimeError("metadata is incomplete")
    used = {n for s in steps.values() for n in s.needs}
    unknown = used - set(sources) - set(steps)
    if unknown:
        raise ValueError(f"neither sources nor steps: {sorted(unknown)}")
    tables, digests = dict(sources), {n: rows_digest(df) for n, df in sources.items() if n in used}
    out: dict[str, Built] = {}
    waiting = dict(steps)
    while waiting:
        ready = [n for n, s in waiting.items() if all(x in digests for x in s.needs)]
        if not ready:
            raise ValueError(f"steps need each other: {sorted(waiting)}")
        for name in ready:
            step = waiting.pop(name)
            key = json.dumps([name, step.version, step.params, [[n, digests[n]] for n in step.needs]], sort_keys=True)
            digests[name] = hashlib.sha256(key.encode()).hexdigest()
            path = f"{root}/{name}/{digests[name]}"
            fresh = not _exists(spark, f"{path}/_SUCCESS")
            if fresh:
                step.build(*[tables[n] for n in step.needs], **step.params).write.mode("overwrite").parquet(path)
            tables[name] = spark.read.parquet(path)
            out[name] = Built(tables[name], digests[name], path, fresh)
    return out
