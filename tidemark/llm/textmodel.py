"""Sparse text features and their selection on a bounded sample of labelled rows.

Features of a word: its letters (of very long words the first 40), their first
four and five, and its outline (of the first eight signs). The texts themselves
are read whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import coded_words, gathered, only_word_cache, rows_per_batch, slices, stage

#: Labelled rows that a classifier is fitted on, and features that it keeps.
SAMPLE, FEATURES = 6000, 2000

_LETTERS = regex.compile(r"[^\p{L}]+")
_SHAPE = regex.compile(r"(\p{Lu}+)|(\p{L}+)|(\p{N}+)|(.)\4*", regex.DOTALL)


_TAIL = ".,;:!?%&$*#\"')"


def _outline(m) -> str:
    return "A" if m[1] else "a" if m[2] else "0" if m[3] else m[4] * min(len(m[0]), 2)


def _parts(word: str) -> tuple[str, str]:
    """The lower-cased letters and the outline of a word."""
    if word.isalpha() and word.islower():
        return word, "a"
    core = word.rstrip(_TAIL)
    if core.isalpha():
        tail = word[len(core) :]
        head = "a" if not core[0].isupper() else "A" if core.isupper() else "Aa"
        return core.lower(), (head + (tail if len(tail) < 2 else tail[0] * 2 if tail.count(tail[0]) == len(tail) else _SHAPE.sub(_outline, tail)))[:8]
    return _LETTERS.sub("", word).lower(), _SHAPE.sub(_outline, word)[:8]


def word_features(word: str) -> tuple[str, ...]:
    """The lower-cased letters, their first four and five, and the outline of a word."""
    low, shape = _parts(word)
    out = ["s:" + shape]
    if low:
        out.append("w:" + low[:40])
    if len(low) > 4:
        out += ["4:" + low[:4], "5:" + low[:5]]
    return tuple(out)


class Hits(dict):
    """Word -> indices of its kept features; forgets everything when full. ``hits_of`` shares one between tasks."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index
        # The same by kind, so that a word's features need not be spelled out.
        self.shapes, self.words, self.four, self.five = ({f[2:]: i for f, i in index.items() if f[0] == k} for k in "sw45")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        low, shape = _parts(word)
        found = [self.shapes.get(shape)]
        if low:
            found.append(self.words.get(low[:40]))
            if len(low) > 4:
                found += [self.four.get(low[:4]), self.five.get(low[:5])]
        h = self[word] = tuple([i for i in found if i is not None])
        return h


@lru_cache(maxsize=1)
def hits_of(features: tuple[str, ...]) -> Hits:
    return Hits({f: i for i, f in enumerate(features)})


class Sparse(NamedTuple):
    """The nonzero feature values of some texts, and how many words each has."""

    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    words: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Per text the product with a vector, or with each column of a matrix."""
        if w.ndim == 1:
            return np.bincount(self.rows, self.vals * w[self.cols], minlength=len(self.words))
        return np.stack([self.dot(c) for c in w.T], 1)


def values(texts: pa.Array, hits: Hits, size: int, presence: float = 0.0) -> Sparse:
    """Feature values of a batch: the logarithm of the count per hundred words, 0 if absent and 1 for one.

    ``presence`` is added for every feature that occurs. Without it only density
    counts, so that chance hits in a very long text add nothing.
    """
    codes, lens, words = coded_words(texts)
    found = [hits[w] for w in words]
    many = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(many.sum()))
    at = flat[gathered((np.cumsum(many) - many)[codes], many[codes])]
    row = np.repeat(np.repeat(np.arange(len(lens)), lens), many[codes])
    counts = np.bincount(row * size + at, minlength=1)
    cells = np.flatnonzero(counts)
    rows, cols = np.divmod(cells, max(1, size))
    vals = np.log1p(counts[cells] * (400 / np.maximum(1, lens[rows]))) / np.log(5) + presence
    return Sparse(rows, cols, vals, lens)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, y, text) of at most ``limit`` labels, taken by the hash of doc_id, with one text each.

    Of several rows with one doc_id the text of the smallest hash counts: it is
    picked before rows leave their executors, so the sample is bounded however
    often an id is repeated. Null labels and ids are left out.
    """
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _distinct(batches):
    for whole in batches:
        for b in slices(whole, 1):
            codes, lens, words = coded_words(b.column(1))
            of = [word_features(w) for w in words]
            sets = [list(set(chain.from_iterable([of[i] for i in np.unique(c)]))) for c in np.split(codes, np.cumsum(lens)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.string()))], names=["y", "f"])


def choose_features(sample: DataFrame, size: int = FEATURES, least: int = 4) -> list[str]:
    """The features that tell the classes apart best: by the z-score of their share in each class against the rest."""
    sets = stage(sample.select("y", "text").mapInArrow(_distinct, "y int, f array<string>"))
    per = {r["y"]: r["n"] for r in sets.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(per.values())
    counts = sets.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in per])
    best = F.lit(0.0)
    for y, m in per.items():
        if m == total:
            continue
        p, q = F.col(f"n{y}") / m, (F.col("n") - F.col(f"n{y}")) / (total - m)
        share = F.col("n") / total
        best = F.greatest(best, F.abs(p - q) / F.sqrt(share * (1 - share) * (1 / m + 1 / (total - m)) + 1e-9))
    chosen = counts.where(F.col("n") >= least).select("f", best.alias("z")).orderBy(F.desc("z"), "f").limit(size)
    return [r["f"] for r in chosen.collect()]


def matrix(sample: DataFrame, features: list[str], presence: float = 0.0):
    """(rows, columns, values, y): the sample's nonzero features, bounded by its rows times the features."""
    kept = tuple(features)

    def run(batches):
        only_word_cache("hits", hits_of.cache_clear)
        hits = hits_of(kept)
        for whole in batches:
            for b in slices(whole, 1):
                x = values(b.column(1), hits, len(kept), presence)
                ends = pa.array(np.searchsorted(x.rows, np.arange(b.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(x.cols, pa.int32()), pa.array(x.vals, pa.float32()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["y", "i", "v"])

    got = sample.select("y", "text").mapInArrow(run, "y int, i array<int>, v array<float>").toPandas()
    got = got.sort_values(["y"], kind="stable").reset_index(drop=True)
    rows = np.repeat(np.arange(len(got)), got["i"].str.len().to_numpy(dtype=np.int64)) if len(got) else np.zeros(0, np.int64)
    flat = lambda c, k: np.concatenate([np.asarray(x, k) for x in got[c]]) if len(got) else np.zeros(0, k)
    return rows, flat("i", np.int64), flat("v", np.float64), got["y"].to_numpy(dtype=np.int64)


def minimise(loss_and_slope, start: np.ndarray, steps: int = 250, rate: float = 0.05) -> np.ndarray:
    """Adam over full batches."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = loss_and_slope(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


def per_document(docs: DataFrame, text: str, features: list[str], compute, added: str, presence: float = 0.0) -> DataFrame:
    """``docs`` with the columns ``added`` (a schema), which ``compute`` makes from the ``Sparse`` values of each batch.

    Whole texts are read, in batches of bounded bytes; a longer text stands alone.
    """
    rows_per_batch(docs.sparkSession)
    kept, place = tuple(features), docs.columns.index(text)
    kinds = [(n, _ARROW[k]) for n, k in (x.split() for x in added.split(", "))]
    schema = StructType(docs.schema.fields + StructType.fromDDL(added).fields)

    def run(batches):
        only_word_cache("hits", hits_of.cache_clear)
        hits = hits_of(kept)
        for whole in batches:
            for b in slices(whole, place):
                new = compute(values(b.column(place), hits, len(kept), presence))
                new = [pa.array(list(c) if c.ndim > 1 else c, k) for c, (_, k) in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in kinds)])

    return docs.mapInArrow(run, schema)


_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
