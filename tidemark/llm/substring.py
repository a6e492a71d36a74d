"""Removal of repeated passages by difference-cover anchors.

A window of ``WINDOW`` words repeats if its word sequence also starts anywhere
else. Short anchors of ``WINDOW - PERIOD + 1`` words are hashed only where the
position modulo ``PERIOD`` lies in a difference cover: for any two positions
there is an offset below the period that brings both onto the cover, so two
equal windows always share an anchor at equal offsets. Windows that hold a
repeated anchor are then extended to full length and grouped by a 96-bit hash.

Both groupings count rows under one key (combined on the map side), and the
counts go back to the positions by joins that deal hot keys over many tasks, so
a passage shared by a third of all documents is never gathered or paired.
Equal texts are one class: every window of a class of two or more repeats.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stage, join_dealt, mixed, rows_per_batch, slices, stage, text_or_empty

WINDOW = 35
#: A perfect difference set; its differences are all residues of the period.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1

_ON_COVER = np.zeros(PERIOD, dtype=bool)
_ON_COVER[list(COVER)] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


class _Rolling:
    """Hashes of word windows of any width over many documents at once."""

    def __init__(self):
        self.words = _WordHashes()
        self.powers = [np.ones(1, np.uint64) for _ in range(4)]

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            for i, base in enumerate((*_BASES, *(pow(b, -1, 1 << 64) for b in _BASES))):
                p = np.full(max(n, 1 << 20), base, dtype=np.uint64)
                p[0] = 1
                self.powers[i] = np.cumprod(p)

    def load(self, texts: list[bytes | None]) -> None:
        """Splits the texts; ``at`` is where each word stands in its document."""
        self.split = [t.split() if t else [] for t in texts]
        self.lens = np.array([len(w) for w in self.split], dtype=np.int64)
        n = int(self.lens.sum())
        self._grow(n + 1)
        x = np.fromiter(map(self.words.__getitem__, chain.from_iterable(self.split)), np.uint64, n)
        self.first = np.cumsum(self.lens) - self.lens
        self.at = np.arange(n) - np.repeat(self.first, self.lens)
        self.left = np.repeat(self.lens, self.lens) - self.at
        self.sums = []
        for lane in (0, 1):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((x if lane == 0 else mixed(x + np.uint64(_BASES[1]))) * self.powers[lane][:n], out=s[1:])
            self.sums.append(s)

    def hashes(self, where: np.ndarray, width: int, lane: int) -> np.ndarray:
        s = self.sums[lane]
        return mixed((s[where + width] - s[where]) * self.powers[2 + lane][where]).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(batches):
    """(t, x, text) -> (t, x, n_words, sha, h): the hashes at the document's cover positions, in order."""
    roll = _Rolling()
    for whole in batches:
        for b in slices(whole, 2):
            roll.load(b.column(2).cast(pa.binary()).to_pylist())
            where = np.flatnonzero(_ON_COVER[roll.at % PERIOD] & (roll.left >= ANCHOR) & (roll.at + roll.left >= WINDOW))
            per_doc = np.diff(np.searchsorted(where, np.append(roll.first, len(roll.at))))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(roll.lens),
                    pa.array([_sha(w) for w in roll.split]),
                    _lists(roll.hashes(where, ANCHOR, 0), per_doc, pa.int64()),
                ],
                names=["t", "x", "n_words", "sha", "h"],
            )


def _windows(batches):
    """(t, marks, text) -> (t, at, h, g): the full windows that hold a marked anchor."""
    roll = _Rolling()
    offsets = np.arange(PERIOD)
    cover = np.array(COVER)
    for whole in batches:
        for b in slices(whole, 2):
            roll.load(b.column(2).cast(pa.binary()).to_pylist())
            counts, found = [], []
            for marks, n, first in zip(b.column(1).to_pylist(), roll.lens, roll.first):
                m = np.array(marks, dtype=np.int64)
                anchors = m // len(COVER) * PERIOD + cover[m % len(COVER)]
                starts = np.unique((anchors[:, None] - offsets).ravel())
                starts = starts[(starts >= 0) & (starts <= n - WINDOW)]
                counts.append(len(starts))
                found.append(starts + first)
            where = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    _lists(roll.at[where], counts, pa.int32()),
                    _lists(roll.hashes(where, WINDOW, 0), counts, pa.int64()),
                    _lists(roll.hashes(where, WINDOW, 1) >> 32, counts, pa.int32()),
                ],
                names=["t", "at", "h", "g"],
            )


def _cut(batches):
    """(t, starts, text) -> (t, n_removed, sha) of what is left."""
    for whole in batches:
        for b in slices(whole, 2):
            removed, shas = [], []
            for starts, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                change = np.zeros(len(words) + 1, np.int64)
                s = np.array(starts, dtype=np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, s + WINDOW, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(_sha([w for w, out in zip(words, gone) if not out]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(shas)], names=["t", "n_removed", "sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_words, n_removed and kept_sha256 (lowercase hex of the kept words joined
    by one space).

    Windows are judged on the input. A null or empty text has no words. Repeated
    rows and equal texts repeat each other: with ``WINDOW`` words or more all
    their words go. Shorter texts keep all. Null doc_ids are returned as they
    are. An empty table gives an empty one.

    A text is known by its 64-bit hash; two texts that share it are told apart
    by a second checksum and stop the job rather than being mixed.
    """
    rows_per_batch(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("t"), F.crc32(F.col("text").cast("binary")).alias("x"), "text"
    )
    row_id = F.coalesce("doc_id", "t")
    base = stage(
        keyed.select("t", "x", "text").mapInArrow(_anchors, "t long, x long, n_words long, sha string, h array<long>")
    )
    classes = stage(
        base.groupBy("t").agg(
            F.count("*").alias("n"),
            F.first("n_words").alias("n_words"),
            F.first("sha").alias("sha"),
            F.first("h").alias("h"),
            F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.raise_error(F.lit("two texts share a 64-bit hash"))).alias("x"),
        )
    )
    drop_stage(base)

    anchors = classes.select("t", F.posexplode("h").alias("i", "h"))
    again = stage(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    marks = join_dealt(anchors, again, ["h"], "t").groupBy("t").agg(F.collect_list("i").alias("marks"))
    # One row of each class stands for it; the rows of other copies are not read into Python again.
    chosen = keyed.groupBy("t").agg(F.min(row_id).alias("k"))
    marks = stage(marks.join(chosen, "t"))
    texts = keyed.withColumn("k", row_id)
    windows = stage(
        texts.join(marks, ["t", "k"]).select("t", "marks", "text").mapInArrow(_windows, "t long, at array<int>, h array<long>, g array<int>")
    )
    each = windows.select("t", F.explode(F.arrays_zip("at", "h", "g")).alias("w")).select("t", "w.at", "w.h", "w.g")
    repeated = stage(each.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"))
    single = classes.where("n = 1").select("t")
    starts = stage(join_dealt(each, repeated, ["h", "g"], "t").groupBy("t").agg(F.collect_list("at").alias("starts")).join(single, "t").join(chosen, "t"))
    drop_stage(windows)
    cut = stage(texts.join(starts, ["t", "k"]).select("t", "starts", "text").mapInArrow(_cut, "t long, n_removed long, sha string").dropDuplicates(["t"]))

    every = (F.col("n") > 1) & (F.col("n_words") >= WINDOW)
    result = classes.drop("h", "x").join(cut.withColumnRenamed("sha", "cut_sha"), "t", "left").select(
        "t",
        "n",
        "n_words",
        F.when(every, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(every, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
    return join_dealt(keyed.select("doc_id", "t"), stage(result), ["t"], "doc_id").select("doc_id", "n_words", "n_removed", "kept_sha256")
