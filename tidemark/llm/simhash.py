"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two
fingerprints that differ in at most two bits have a segment without an error,
and the segment after it (in a ring) has at most two. So each fingerprint gives
keys (exact segment, codeword of the next segment): a segment decodes to the
one or six codewords within four bits, and segments at most two bits apart
share one of these. Fingerprints that share a key are joined and verified.

Buckets of at most ``BUCKET`` fingerprints are compared member by member. Those
of larger buckets link through the 65 words within one bit of each: two words
differ in at most two bits exactly when such balls meet, so a star per shared
word gives the same components with a number of rows linear in the bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden_names, join_dealt, rows_per_batch, slices, stage
from tidemark.llm.golay import codeword_keys
from tidemark.llm.graph import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Members up to which a bucket is compared by pairs; above it the exact star of one-bit balls is used.
BUCKET = 32


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """A hash of each run of ``shingle`` words (of all words, if there are fewer); empty if there are none."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII breaks
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    last = (ends[k - 1 :] - 1).tolist()
    first = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), dtype="<u8", count=len(last))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of UTF-8 bytes as an unsigned number; 0 if there are no words."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as an unsigned number; 0 if there are none."""
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8) + _LANES
    seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ _BITS
    return int.from_bytes(np.packbits((ones * 2 > len(h)).ravel(), bitorder="little").tobytes(), "little")


_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): a signed long holding the 64 bits; a null text has no words."""
    return _with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")


def _with_fingerprints(docs: DataFrame, key: str) -> DataFrame:
    """(key, text) -> (key, fp), whole texts of any length."""
    rows_per_batch(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                texts = b.column(1).cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[key, "fp"])

    return docs.mapInArrow(run, f"{key} long, fp long")


def golay_keys(words: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): up to 18 keys of 37 bits for each fingerprint."""

    def run(frames):
        for f in frames:
            v = f["fp"].to_numpy().view(np.uint64)
            parts = [((v >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18))]
            for i in range(3):
                codes, counts = codeword_keys(parts[(i + 1) % 3])
                use = np.arange(6)[None, :] < counts[:, None]
                keys = (i << 35) | (parts[i][:, None] << 12) | codes
                yield pd.DataFrame({"key": keys[use], "fp": np.repeat(f["fp"].to_numpy(), counts)})

    return words.select("fp").mapInPandas(run, "key long, fp long")


def links(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all links of at most two bits."""
    keys = golay_keys(words)
    sizes = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stage(join_dealt(keys, sizes, ["key"], "fp"))
    pairs = (
        shared.where(F.col("n") <= bucket)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("m"))
        .select(
            F.explode(
                F.expr(
                    "flatten(transform(m, a -> transform(filter(m, b -> b > a and bit_count(a ^ b) <= 2), b -> struct(a as u, b as v))))"
                )
            ).alias("p")
        )
        .select("p.u", "p.v")
    )
    balls = (
        shared.where(F.col("n") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("c"))
    )
    centre = balls.groupBy("c").agg(F.min("fp").alias("v"), F.count("*").alias("k")).where("k > 1")
    stars = balls.join(centre.select("c", "v"), "c").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def _rooted(words: DataFrame, bucket: int) -> DataFrame:
    """Distinct fingerprints (fp, ...) with the smallest one that each reaches."""
    groups = components(links(words, bucket)).withColumnRenamed("id", "fp")
    return words.join(groups, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def text_classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(h, root): near-duplicate class of each distinct text, known by its ``text_hash``."""
    fps = stage(_with_fingerprints(docs.select(text_hash().alias("h"), "text"), "h").distinct())
    return fps.join(_rooted(fps.select("fp").distinct(), bucket), "fp").select("h", "root")


def text_hash(text: str = "text") -> Column:
    """Names equal texts; null ones are empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def simhash_components(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable over links of at most two bits) and kept (doc_id = component_id;
    of repeated rows of a doc_id, all are marked alike).

    A null or empty text, or one without words, has fingerprint zero and links
    like any other. Null doc_ids are returned with the class they belong to but
    never name it; a class of null ids alone has a null component_id. Ties and
    repeated rows share a class; an empty table gives an empty one.
    """
    fps = stage(fingerprints(docs))
    joined = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), bucket)
    named = joined.join(joined.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_first(docs: DataFrame, classes=text_classes) -> DataFrame:
    """One row of each near-duplicate class of texts (by ``classes``), with all columns of ``docs``, whatever their names.

    The row of the smallest doc_id stays; rows with a null doc_id are members
    of their text's class and stay only where it has no others. Different texts
    of one doc_id are judged like any others; of rows with equal doc_id and text,
    one stays. Null and empty texts are one class. Texts of any length are read
    whole; an empty table gives an empty one.
    """
    no_id = -(1 << 63)
    hidden, names = hidden_names(docs)
    own_id, own_text = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = hidden.withColumn("k", F.coalesce(F.col(own_id).cast("long"), F.lit(no_id))).withColumn("h", text_hash(own_text))
    # Rows of one text are combined before any of them moves.
    low = keyed.groupBy("h").agg(F.min(F.struct(F.col("k") == no_id, "k")).alias("low"))
    first = low.join(classes(docs), "h").groupBy("root").agg(F.min(F.struct("low", "h")).alias("first")).select("first.low.k", "first.h")
    return keyed.join(first, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select(*names)
