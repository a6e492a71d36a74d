"""Near-duplicate texts by the exact Jaccard similarity of their word shingles.

Candidates are first the texts whose SimHashes of these shingles are at most two
bits apart, found by ``simhash.links`` (Golay keys). At a similarity of 0.8,
64-bit SimHashes differ in about ten bits, often in more than 16, where segments
cut by pigeonhole are too short to select anything. Those that share one of
``BANDS`` bands of ``ROWS`` min-hashes (missed at 0.8 with a chance of 0.0002) are
therefore candidates too. Each is verified on the shingle sets themselves.

The members of a bucket are compared with a few centres first, which is linear
and joins most of them. Members that stay in different components are compared
pair by pair, in blocks of bounded size out of which only links come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, rows_per_batch, slices, stage
from tidemark.llm.graph import components
from tidemark.llm.simhash import links as fingerprint_links
from tidemark.llm.simhash import majority, shingle_hashes, text_hash

#: Words of a shingle; similarity as a fraction of whole numbers, so that it is compared exactly.
SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 16, 4
#: Centres of a bucket, and members of a block when the rest is compared by pairs.
CENTRES, BLOCK = 4, 256

_draw = np.random.default_rng(8)
_FACTORS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = _draw.integers(0, 1 << 63, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A number for each band of min-hashes; the band's place is part of it."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (h[None, at : at + 4096] * _FACTORS + _SHIFTS).min(1))
    low ^= low >> np.uint64(29)
    mixed = (low.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, without repeats) reach ``SIMILARITY``."""
    num, den = SIMILARITY
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * den >= num * (len(a) + len(b) - shared)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, h, t, fp, bands): h and t name equal texts, fp is the SimHash; texts without words are one t, 0, and have no bands."""
    rows_per_batch(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2):
                names, fps, keys = [], [], []
                for t, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                    h = shingle_hashes(text or b"", SHINGLE)
                    names.append(t if len(h) else 0)
                    fps.append(majority(h))
                    keys.append(bands(h).tolist() if len(h) else [])
                fp = np.array(fps, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "t", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, t long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(t, text) -> (t, grams): the sorted distinct shingles as bytes."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(x, SHINGLE)).tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["t", "grams"])

    return texts.mapInArrow(run, "t long, grams binary")


def near_fingerprints(classes: DataFrame) -> DataFrame:
    """(t, fp, bands) -> candidates (u, v), u > v: texts of one fingerprint meet its first, and first texts those at most two bits away."""
    worded = classes.where(F.size("bands") > 0).select("t", "fp")
    words = stage(worded.groupBy("fp").agg(F.min("t").alias("first"), F.count("*").alias("n")))
    same = join_dealt(worded, words.where("n > 1"), ["fp"], "t").where("t <> first").select(F.col("t").alias("u"), F.col("first").alias("v"))
    first = lambda end: words.select(F.col("fp").alias(end), F.col("first").alias(f"text_{end}"))
    other = fingerprint_links(words).distinct().join(first("u"), "u").join(first("v"), "v")
    return same.union(other.select(F.greatest("text_u", "text_v").alias("u"), F.least("text_u", "text_v").alias("v")))


def _verify(batches):
    """(u, v, gu, gv) -> (u, v) of similar sets."""
    for b in batches:
        ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _compare(batches):
    """Blocks (key, members: t, label, minor, left, bands, grams) -> (u, v) of similar sets with different labels."""
    for batch in batches:
        for key, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets = [np.frombuffer(m["grams"], "<u8") for m in members]
            keys = np.array([m["bands"] for m in members])
            place = int(key) % BANDS
            right = [i for i, m in enumerate(members) if not m["left"]]
            us, vs = [], []
            for i, m in enumerate(members):
                if not m["left"]:
                    continue
                for j in right:
                    o = members[j]
                    # A pair of two minor members stands in two blocks, and a pair may share several bands: once is enough.
                    if m["label"] == o["label"] or (o["minor"] and o["t"] > m["t"]) or (keys[i, :place] == keys[j, :place]).any():
                        continue
                    if similar(sets[i], sets[j]):
                        us.append(m["t"])
                        vs.append(o["t"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def links(classes: DataFrame, texts: DataFrame, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """(t, fp, bands) and (t, text) -> (u, v) of similar texts, whose components join all similar pairs that share a band and those of ``near_fingerprints``."""
    close = stage(near_fingerprints(classes))
    keys = classes.select("t", F.explode("bands").alias("key"))
    order = [F.min(F.struct(F.xxhash64("t", F.lit(i)), "t"))["t"] for i in range(centres)]
    buckets = stage(keys.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*order)).alias("centres")).where("n > 1"))
    shared = stage(join_dealt(keys, buckets, ["key"], "t"))
    met = shared.select("t").union(close.select("u")).union(close.select("v")).distinct()
    grams = stage(shingle_sets(texts.join(met, "t", "left_semi").dropDuplicates(["t"]).select("t", "text")))
    pairs = shared.select("t", F.explode("centres").alias("o")).where("t <> o").select(F.greatest("t", "o").alias("u"), F.least("t", "o").alias("v")).union(close).distinct()
    gu, gv = grams.select(F.col("t").alias("u"), F.col("grams").alias("gu")), grams.select(F.col("t").alias("v"), F.col("grams").alias("gv"))
    near = stage(pairs.join(gu, "u").join(gv, "v").select("u", "v", "gu", "gv").mapInArrow(_verify, "u long, v long"))

    joined = components(near).select(F.col("id").alias("t"), "component")
    # With at most ``centres`` members that are all centres, every pair has been compared.
    open_ = shared.where(F.col("n") > F.size("centres")).join(joined, "t", "left").select("key", "t", F.coalesce("component", "t").alias("label"))
    counts = open_.groupBy("key", "label").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most")).where("n > most.k")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    dealt = open_.join(sizes.select("key", F.col("most.label").alias("most"), blocks(F.col("n")).alias("rights"), blocks(F.col("n") - F.col("most.k")).alias("lefts")), "key").withColumn("minor", F.col("label") != F.col("most"))
    deal = lambda n: F.pmod(F.xxhash64("t"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("minor").select("key", "t", "label", "minor", F.lit(True).alias("left"), deal("lefts").alias("l"), spread("rights").alias("r"))
    right = dealt.select("key", "t", "label", "minor", F.lit(False).alias("left"), deal("rights").alias("r"), spread("lefts").alias("l"))
    members = left.unionByName(right).join(classes.select("t", "bands"), "t").join(grams, "t")
    groups = members.groupBy("key", "l", "r").agg(F.collect_list(F.struct("t", "label", "minor", "left", "bands", "grams")).alias("members"))
    rest = groups.select("key", "members").mapInArrow(_compare, "u long, v long")
    return near.union(rest)


def _rooted(rows: DataFrame, docs: DataFrame, centres: int, block: int) -> DataFrame:
    """``sketches`` -> (t, low, root): the smallest doc_id of each text and its class."""
    classes = stage(rows.groupBy("t").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    texts = docs.select(text_hash().alias("t"), "text")
    found = components(links(classes, texts, centres, block)).withColumnRenamed("id", "t")
    return classes.select("t", "low").join(found, "t", "left").select("t", "low", F.coalesce("component", "t").alias("root"))


def text_classes(docs: DataFrame, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """(h, root): class of similar texts of each distinct text, known by its ``text_hash``."""
    rows = stage(sketches(docs))
    return rows.select("h", "t").distinct().join(_rooted(rows, docs, centres, block), "t").select("h", "root")


def similar_components(docs: DataFrame, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> doc_id, component_id (smallest doc_id reachable over similar texts) and kept.

    Texts without words, null ones too, are one class. Null doc_ids belong to
    classes but never name them. Texts of any length are compared whole; repeated
    rows share a class, an empty table gives an empty one, other columns are ignored.
    """
    rows = stage(sketches(docs))
    named = _rooted(rows, docs, centres, block)
    ids = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("t", "component_id")
    return rows.select("doc_id", "t").join(ids, "t").select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
