"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases: the shortest piece not yet in the
dictionary becomes a phrase and enters it. The phrase set is hashed and the
``SIZE`` smallest hashes are the fingerprint. Two fingerprints are compared on
the smallest hashes of their union, an estimate of how much of their
dictionaries two texts share, as a compressor would.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_per_batch, text_or_empty

SIZE = 128


def _parse(text: str, seen: set[str], rest: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` (after an unfinished phrase) and the unfinished phrase left; ``seen`` grows."""
    new = []
    w = rest
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            new.append(w)
            w = ""
    return new, w


def _hashes(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))


def _smallest(*hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(hashes))[:SIZE]


def signature(text: str) -> np.ndarray:
    """The ``SIZE`` smallest hashes of the text's phrases, rising."""
    return _smallest(_hashes(_parse(text, set())[0]))


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the smallest hashes of the union; 1 for two empty sets."""
    union = np.union1d(a, b)[:SIZE]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


class _Parsed:
    """A text's signature, and those of its edited forms; the half that they share is parsed once."""

    def __init__(self, text: str):
        self.text, self.kept = text, len(text) - len(text) // 2
        self.seen: set[str] = set()
        head, self.rest = _parse(text[: self.kept], self.seen)
        self.shared = _hashes(head)
        self.tail, _ = _parse(text[self.kept :], self.seen, self.rest)
        self.own = _smallest(self.shared, _hashes(self.tail))

    def changed(self, other: str) -> tuple[str, np.ndarray]:
        start = other[: len(self.text) - self.kept]
        self.seen.difference_update(self.tail)
        self.tail, _ = _parse(start, self.seen, self.rest)
        return self.text[: self.kept] + start, _smallest(self.shared, _hashes(self.tail))


def _show(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint(batches):
    """Rows (part, guest, doc_id, text) in order -> results; the row after a document is its next one."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    waiting = None
    out: list[tuple] = []

    def flush():
        rows = list(zip(*out)) or [()] * len(names)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    for b in batches:
        for part, guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            if waiting is not None and waiting[0] == part:
                _, mine, now = waiting
                following = now if text == now.text else _Parsed(text)
                changed, other = now.changed(text)
                sha = hashlib.sha256(changed.encode(errors="replace")).hexdigest()
                out.append((mine, len(now.text), sha, _show(now.own), _show(other), likeness(now.own, other), likeness(now.own, following.own)))
                waiting = None if guest else (part, doc, following)
            elif not guest:
                waiting = (part, doc, _Parsed(text))
            if len(out) >= 256:
                yield flush()
    yield flush()


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint (hex of the sorted
    hashes), near_edited and near_next.

    The next document is the next one by falling doc_id, after the last the
    first; a single document is its own next. Rows of one doc_id follow by a
    hash of their text, so repeated rows are neighbours; null doc_ids come last.
    A null text is empty: it has no phrases, and is wholly like another empty
    one. An empty table gives an empty one.

    The table moves once, into ranges of (doc_id, hash of the text) whose heads
    are rows of it (two numbers for each range, from a range sort of these
    numbers alone); the rows of a head also go to the range before it, where
    they end the last document's wait. So the rows of one doc_id, or of none,
    are split like others. Texts are parsed whole, whatever their length.
    """
    spark = docs.sparkSession
    rows_per_batch(spark, 256)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty()
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("tie"))
    ranges = docs.select(key.alias("key")).repartitionByRange(parts, F.desc("key")).groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("head"))
    cuts = sorted({(r["head"]["k"], r["head"]["tie"]) for r in ranges.collect()}, reverse=True)  # one a range
    if not cuts:
        return spark.createDataFrame([], _OUT)
    n = len(cuts)
    listed = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("tie")) for k, t in cuts])
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")

    def halve(a, _):
        above = F.element_at(listed, middle(a) + 1) >= F.col("key")
        return F.struct(F.when(above, middle(a)).otherwise(a["lo"]).alias("lo"), F.when(above, a["hi"]).otherwise(middle(a)).alias("hi"))

    # Binary search: the last cut that is not below the key.
    steps, whole = F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    search = F.aggregate(steps, whole, lambda a, i: F.when(a["hi"] - a["lo"] > 1, halve(a, i)).otherwise(a), lambda a: a["lo"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key")).withColumn("part", search)
    head = F.element_at(listed, F.col("part") + 1) == F.col("key")
    home = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    away = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("guest"))
    placed = keyed.withColumn("at", F.explode(F.when(head, F.array(home, away)).otherwise(F.array(home))))
    ordered = placed.select("at.part", "at.guest", "key", "doc_id", "text").repartitionById(n, "part").sortWithinPartitions("part", "guest", F.desc("key"))
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(_fingerprint, _OUT)
