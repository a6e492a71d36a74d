"""Alignment of two tokenizers over the same texts.

Each text is encoded whole by both. Ends that both share before tokens that
start with a space are anchors; between them lie windows of token ids, most of
them a word, so windows repeat: each distinct pair of id tuples is aligned once
and remembered. Groups and links of a text are those of its windows.

How many documents hold a link is counted by blocks of texts: a block has each
id pair once, so what is shuffled and joined grows with the pairs of a block, not
with the links of its texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import gathered, join_dealt, only_word_cache, rows_per_batch, slices, stage
from tidemark.llm.prefixes import byte_signs

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and in a string that is encoded at once.
BLOCK, STRETCH = 2 << 20, 1 << 12

_SPACE = "▁"
_RIGHT = np.uint32(1 << 31)


def _interleaved(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The parts that ``i`` and ``j`` cut (from 0 to the lengths), each part of ``left`` before that of ``right``."""
    out = np.empty(len(left) + len(right), left.dtype)
    out[np.arange(len(left)) + np.repeat(j[:-1], np.diff(i))] = left
    out[np.arange(len(right)) + np.repeat(i[1:], np.diff(j))] = right
    return out


def _unknown(wanted, young: dict, old: dict) -> list:
    """What is in neither; what is in ``old`` alone moves to ``young``."""
    lacking = [x for x in wanted if x not in young]
    young.update({x: old[x] for x in lacking if x in old})
    return [x for x in lacking if x not in young]


class Aligner:
    """Both tokenizers, the ids of units and the alignments of windows seen so far. ``aligner`` shares one between tasks.

    A unit starts with spaces behind another sign; neither tokenizer has a token
    over such a place (checked for ``right``), so ids of units join to those of
    the text. What is remembered stands in two generations of at most ``most``
    entries (and those of a block): a full young one becomes the old one.
    """

    def __init__(self, left: str, right: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.left, self.right, self.most = Tokenizer.from_file(left), SentencePieceProcessor(model_file=right), most
        self.left.encode_special_tokens = True
        signs, model = byte_signs(), json.load(open(left, encoding="utf-8"))["model"]
        names = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in names):
            raise ValueError(f"{right} has pieces that go on behind a space")
        self.bytes_left = {i: "".join([signs.get(c, c) for c in t]).encode("latin-1") for t, i in model["vocab"].items() if all(c in signs for c in t)}
        self.bytes_right = {i: bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)}
        self.sizes = [self._table(t, len, np.int64) for t in (self.bytes_left, self.bytes_right)]
        self.spaced = [self._table(t, lambda b: b[:1] == b" ", bool) for t in (self.bytes_left, self.bytes_right)]
        white = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
        # Spaces and other white space, then no white space; again as long as white space that is no space follows.
        self.units = re.compile(f"[ {white}]*[^ {white}]+(?:[{white}][ {white}]*[^ {white}]+)*(?:[ {white}]+\\Z)?|[ {white}]+").findall
        # Ids written: those of the first tokenizer before a comma or the group's bar, those of the second before a comma or its end.
        self.written = pa.array([f"{i}{end}" for sizes, ends in zip(self.sizes, (",|", ",;")) for end in ends for i in range(len(sizes))], pa.large_binary())
        self.ids: dict[str, bytes | None] = {}
        self.windows: dict[bytes, tuple[bytes, int, bytes]] = {}
        self.old_ids, self.old_windows = {}, {}

    @staticmethod
    def _table(values: dict[int, bytes], f, kind) -> np.ndarray:
        out = np.zeros(max(values) + 1, kind)
        out[list(values)] = [f(b) for b in values.values()]
        return out

    def learn(self, new: list[str]) -> None:
        """Ids of units, encoded together (without offsets, which cost much); None for one whose bytes the second tokenizer changes."""
        data = [u.encode() for u in new]
        ends = np.cumsum([len(d) for d in data])
        cuts = [0, *(np.flatnonzero(np.diff(ends // STRETCH)) + 1).tolist(), len(new)]
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        strings = ["".join(new[a:b]) for a, b in parts]
        for (a, b), x, y in zip(parts, self.left.encode_batch_fast(strings, add_special_tokens=False), self.right.encode([s[1:] for s in strings], num_threads=1)):
            self._keep(new[a:b], data[a:b], x.ids, y)

    def _keep(self, units: list[str], data: list[bytes], left: list[int], right: list[int]) -> None:
        cuts = np.cumsum([0, *map(len, data)])
        both, at = [], []
        for ids, sizes, mark in ((left, self.sizes[0], 0), (right, self.sizes[1], _RIGHT)):
            ids = np.array(ids, np.uint32)
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            found = np.searchsorted(ends, cuts)
            if ends[-1] != cuts[-1] or (ends[found] != cuts).any():
                break
            both.append(ids | np.uint32(mark))
            at.append(found)
        if len(both) == 2 and b"".join([self.bytes_right[i] for i in right]) == b"".join(data):
            raw, ends = _interleaved(*both, *at).tobytes(), (4 * (at[0] + at[1])).tolist()
            self.ids.update(zip(units, [raw[x:y] for x, y in zip(ends, ends[1:])]))
        elif len(units) > 1:
            for u, d in zip(units, data):
                self._keep([u], [d], self.left.encode(u, add_special_tokens=False).ids, self.right.encode(u[1:]))
        else:
            self.ids[units[0]] = None

    def align(self, new: list[bytes]) -> None:
        """Keeps for each window its groups as text (each ends with a semicolon), their number, and its links as pairs of 32-bit ids."""
        ids = np.frombuffer(b"".join(new), np.uint32)
        second = ids >= _RIGHT
        ends_of = np.cumsum([len(w) // 4 for w in new])  # in ids of both
        left, right = ids[~second], ids[second] ^ _RIGHT
        a, b = np.cumsum(self.sizes[0][left]), np.cumsum(self.sizes[1][right])
        # Between two neighbouring ends, one token of each side lies: that is a link.
        segments = np.union1d(a, b)
        i, j = np.searchsorted(a, segments), np.searchsorted(b, segments)
        links = np.stack([left[i], right[j]], 1).astype(np.uint32).tobytes()
        shared = (a[i] == segments) & (b[j] == segments)
        i1, j1 = i[shared] + 1, j[shared] + 1  # ends of groups
        last = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
        last[0][i1 - 1], last[1][j1 - 1] = True, True
        n, m = map(len, self.sizes)
        # A group's ids of the first side stand before those of the second.
        names = _interleaved(left + n * last[0], right + 2 * n + m * last[1], np.concatenate([[0], i1]), np.concatenate([[0], j1]))
        text = self.written.take(pa.array(names.astype(np.int64)))
        spelled, cuts = text.buffers()[2].to_pybytes(), np.frombuffer(text.buffers()[1], np.int64)[: len(names) + 1]
        stops = cuts[ends_of].tolist()
        window_end = np.cumsum(self.sizes[0][left])[np.cumsum(~second)[ends_of - 1] - 1]  # in bytes
        link_stops = np.searchsorted(segments, window_end, side="right").tolist()
        groups = np.cumsum(shared)[np.array(link_stops) - 1].tolist()
        for w, x, y, u, v, g, h in zip(new, [0, *stops], stops, [0, *link_stops], link_stops, [0, *groups], groups):
            self.windows[w] = spelled[x:y], h - g, links[8 * u : 8 * v]

    def block(self, texts: list[str | None]):
        """The texts of a block aligned: their numbers, groups, and links by the place of their id pair among the block's."""
        spaced = [" " + t if t else "" for t in texts]
        units = [self.units(s) for s in spaced]
        lens = np.array([len(u) for u in units], np.int64)
        flat = [u for per in units for u in per]
        place: dict[str, int] = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        if len(self.ids) > self.most:
            self.ids, self.old_ids = {}, self.ids
        new = _unknown(place, self.ids, self.old_ids)
        if new:
            self.learn(new)
        ids = [self.ids[u] for u in place]
        codes = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        text_of = np.repeat(np.arange(len(texts)), lens)
        bad = np.zeros(len(texts), bool)
        bad[text_of[np.array([x is None for x in ids], bool)[codes]]] = True
        codes, text_of = codes[~bad[text_of]], text_of[~bad[text_of]]

        flat = np.frombuffer(pa.array([x or b"" for x in ids], pa.large_binary()).take(pa.array(codes)).buffers()[2] or b"", np.uint32)
        second = flat >= _RIGHT
        text_of = np.repeat(text_of, np.array([len(x or b"") // 4 for x in ids], np.int64)[codes])
        sides = flat[~second], flat[second] ^ _RIGHT
        counts = [np.bincount(t, minlength=len(texts)) for t in (text_of[~second], text_of[second])]
        ends = [np.cumsum(sizes[x]) for sizes, x in zip(self.sizes, sides)]
        window_text, codes, table = self._windows(sides, ends, counts)
        known = [self.windows[w] for w in table]
        return counts, window_text, codes, known

    def _windows(self, sides, ends, counts):
        """(the text of each window, its place among the distinct windows, the distinct windows, aligned)."""
        (left, right), (a, b) = sides, ends
        at = np.searchsorted(b, a)
        i = np.flatnonzero(b[at] == a) if len(a) else np.zeros(0, np.int64)
        j = at[i]
        starts = [np.append(self.spaced[k][sides[k]], True) for k in (0, 1)]
        anchor = starts[0][i + 1] & starts[1][j + 1]
        i, j = i[anchor] + 1, j[anchor] + 1  # ends of windows
        i0, j0 = np.concatenate([[0], i]), np.concatenate([[0], j])
        keys = _interleaved(left, right | _RIGHT, i0, j0)
        offsets = (4 * (i0 + j0)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(keys)]).dictionary_encode()
        table = coded.dictionary.to_pylist()
        if len(self.windows) > self.most:
            self.windows, self.old_windows = {}, self.windows
        new = _unknown(table, self.windows, self.old_windows)
        if new:
            self.align(new)
        text = np.searchsorted(np.cumsum(counts[0]), i - 1, side="right")
        return text, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), table


@cache
def aligner(left: str, right: str) -> Aligner:
    return Aligner(left, right)


_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_pairs long, pairs binary, seen array<struct<a:long,b:long,docs:long>>"


def _block_rows(known: Aligner, block: int, ids: pa.Array, texts: list[str | None], with_groups: bool) -> pa.RecordBatch:
    (n_a, n_b), window_text, codes, found = known.block(texts)
    n = len(texts)
    groups = np.array([f[1] for f in found], np.int64)
    flat = np.frombuffer(b"".join([f[2] for f in found]), np.uint32).reshape(-1, 2).astype(np.int64)
    links = np.array([len(f[2]) // 8 for f in found], np.int64)
    pairs, place = np.unique(flat[:, 0] << 32 | flat[:, 1], return_inverse=True)
    every = place.ravel()[gathered((np.cumsum(links) - links)[codes], links[codes])] if len(codes) else np.zeros(0, np.int64)
    cell, times = np.unique(np.repeat(window_text, links[codes]) * max(1, len(pairs)) + every, return_counts=True)
    text, at = np.divmod(cell, max(1, len(pairs)))
    docs = np.bincount(at, minlength=len(pairs))
    cuts = np.searchsorted(text, np.arange(n + 1))
    packed = [pa.compress(np.stack([np.diff(at[x:y], prepend=0), times[x:y]]).astype(np.uint32).tobytes(), "zstd", asbytes=True) for x, y in zip(cuts, cuts[1:])]

    written = pa.array([f[0] for f in found], pa.large_binary()).take(pa.array(codes))
    ends = np.frombuffer(written.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
    stops = ends[np.searchsorted(window_text, np.arange(n), side="right")]
    data = memoryview(written.buffers()[2] or b"")
    spans = [(x, y - 1) if y > x else (x, x) for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]
    digest = [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in spans]
    whole = [str(data[x:y], "ascii") if with_groups else None for x, y in spans]

    add = lambda values: np.bincount(window_text, values[codes], n).astype(np.int64)
    seen = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (pairs >> 32, pairs & 0xFFFFFFFF, docs)], names=["a", "b", "docs"])
    last = pa.nulls(1, pa.int64())
    longs = lambda v, end: pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.int64()), end])
    columns = [
        pa.array(np.full(n + 1, block), pa.int64()),
        longs(ids, last),
        *[longs(v, last) for v in (n_a, n_b, add(groups), add(links))],
        pa.array([*digest, None], pa.string()),
        pa.array([*whole, None], pa.string()),
        longs(np.diff(cuts), last),
        pa.array([*packed, None], pa.binary()),
        pa.concat_arrays([pa.nulls(n, pa.list_(seen.type)), pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), seen)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in _ROW.split(", ")])


def _blocks(docs: DataFrame, left: str, right: str, with_groups: bool, size: int) -> DataFrame:
    """A row for each text and, behind those of its block, one with the block's id pairs and how many of its texts hold each."""
    rows_per_batch(docs.sparkSession, 2048)

    def run(batches):
        only_word_cache("alignment", aligner.cache_clear)
        known = aligner(left, right)
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, 1, size):
                yield _block_rows(known, block, b.column(0), b.column(1).to_pylist(), with_groups)
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def _weigh(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block and the corpus counts of its pairs -> the sums for each text."""
    place = pairs["place"].to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    n[place], best[place] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    n_best, count_sum = [], []
    for size, packed in zip(texts["n_pairs"].to_pylist(), texts["pairs"].to_pylist()):
        steps, times = np.frombuffer(pa.decompress(packed, 8 * size, "zstd", asbytes=True) if size else b"", np.uint32).reshape(2, -1).astype(np.int64)
        at = np.cumsum(steps)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * n[at]).sum()))
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokenizers(docs: DataFrame, left: str, right: str, with_groups: bool = False, size: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; with groups if asked for.

    ``left`` is a byte-level pair encoding (A), which reads a space and the text,
    ``right`` a sentencepiece model (B) that adds the space itself. A link is a
    pair of an A and a B token that share bytes; its count is the number of
    documents (rows) that hold its id pair; it is best if no other pair of its
    A id is counted higher.

    Null and empty texts, and texts that B changes, have no tokens: zeros and an
    empty string. Texts of any length are read whole. Every row is a document,
    so repeated rows and rows without an id each count and are returned. Other
    columns are ignored; an empty table gives an empty one.
    """
    blocks = stage(_blocks(docs, left, right, with_groups, size))
    seen = blocks.where("seen is not null").select("block", F.posexplode("seen").alias("place", "pair")).select("block", "place", "pair.*")
    counts = seen.groupBy("a", "b").agg(F.sum("docs").alias("n"), F.count("*").alias("blocks"))
    # An id has at most as many partners as the other vocabulary has ids.
    counts = stage(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))))
    weighed = join_dealt(seen.select("block", "place", "a", "b"), counts, ["a", "b"], "block", "blocks").select(F.col("block").alias("of"), "place", "n", "best")
    texts = blocks.where("seen is null").drop("seen")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    out = texts.groupBy("block").cogroup(weighed.groupBy("of")).applyInArrow(_weigh, kind)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
