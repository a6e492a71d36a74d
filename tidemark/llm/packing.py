"""Best-fit packing of token pieces into sequences of a fixed length.

Bulk-synchronous: pieces are range-sorted by falling length once, gaps (what is
left of open sequences) after every superstep; both have a rank within their
size. Pieces are placed by bands of lengths, the longest band first. A superstep
matches all pieces of the band with all gaps at once:

* successor sweep: every piece, by falling length, takes the smallest free gap
  that holds it. Seen as brackets in the order of sizes, gaps open and pieces
  close; the depth of a row follows from its rank and the counts of the sizes, a
  piece takes the gap before it at its own depth. So conflicts are resolved by
  rank, one shuffle by depth brings the two together, and a depth has at most
  two rows for each size;
* fill sweep, first, where gaps hold two or more pieces: gaps and pieces are laid
  end to end on one line, and every gap takes the pieces that start in its part.

Gaps are updated, written and ranked again, until a sweep would match nothing;
what is left of the band opens new sequences, and the next band follows. Only
counts by size (at most ``LENGTH``) reach the driver; rows are matched by Spark.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import coded, drop_stage, listed, only_word_cache, row_tie, rows_per_batch, slices, stage

LENGTH, SEPARATOR = 2048, 0
TOKENIZER = "word_bpe_49k.json"

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN_WORD = "^[!-~¡-įı-ſ]+$"
_PLAIN = regex.compile(_PLAIN_WORD)


class Encoder:
    """Ids of whole texts from those of their words.

    White-space separated words never share a token, so their ids join to those
    of the text; nor do the parts of a word (letters, digits, signs). Parts not
    yet known are encoded in one call, joined by spaces: each ends in the one
    token that carries a word end. When full, the cache keeps only what the
    texts at hand hold. ``encoder`` shares one between the tasks of a worker.
    """

    def __init__(self, file: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        self.parts: dict[str, bytes] = {}  # also words whose parts are not told apart here
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        ids = self._ids(" ".join(new))
        ends = np.flatnonzero(self.ends[ids]) * 4 + 4
        if len(ends) == len(new):
            data, at = ids.tobytes(), [0, *ends.tolist()]
            self.parts.update(zip(new, [data[a:b] for a, b in zip(at, at[1:])]))
        else:
            self.parts.update((p, self._ids(p).tobytes()) for p in new)

    def _odd(self, words: list[str]) -> list[bytes]:
        """Words with digits, signs inside or letters of other scripts."""
        split = [_PARTS.findall(s.lower()) if _PLAIN.fullmatch(s) and "<|" not in s else None for s in words]
        self._know({p for w in split if w for p in w})
        for s, w in zip(words, split):
            if w is None and s not in self.parts:
                self.parts[s] = self._ids(s).tobytes()
        return [self.parts[s] if w is None else b"".join([self.parts[p] for p in w]) for s, w in zip(words, split)]

    def _know(self, parts) -> None:
        new = [p for p in parts if p not in self.parts]
        if new:
            self._learn(new)

    def _ids_of(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """A table of ids, and for each distinct word the places in it of its letters (or all of it) and of its stop."""
        if not len(words):
            return pa.array([b""], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = pc.utf8_lower(words)
        core = pc.ascii_rtrim(low, ".,")
        tail = (pc.binary_length(low).to_numpy() - pc.binary_length(core).to_numpy()).astype(np.int64)
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~plain)
        plain[other] = pc.match_substring_regex(words.take(pa.array(other)), _PLAIN_WORD).to_numpy(zero_copy_only=False)
        simple = plain & (tail < 2) & pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)  # most words: letters, and perhaps a stop
        at, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        cores = core.take(pa.array(at)).dictionary_encode()
        names, odd = listed(cores.dictionary), listed(words.take(pa.array(rest)))
        if len(self.parts) > self.most:
            self.parts = {p: self.parts[p] for p in names if p in self.parts}
        self._know([".", ",", *names])
        known = self.parts
        table = pa.array([b"", known["."], known[","], *[known[p] for p in names], *self._odd(odd)], pa.large_binary())
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[at] = cores.indices.to_numpy(zero_copy_only=False) + 3
        first[rest] = np.arange(len(rest)) + 3 + len(names)
        stops = at[tail[at] == 1]
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset + 1 : low.offset + 1 + len(low)]
        second[stops] = np.where(np.frombuffer(low.buffers()[2], np.uint8)[ends[stops] - 1] == ord("."), 1, 2)
        return table, first, second

    def encode(self, texts) -> list[bytes]:
        """The ids (little-endian) of each text of a list (UTF-8) or Arrow column; a null has none."""
        codes, lens, words = coded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        table, first, second = self._ids_of(words)
        # Arrow gathers the ids: one buffer holds those of all texts in order.
        got = table.take(pa.array(np.stack([first[codes], second[codes]], 1).ravel()))
        ends = np.frombuffer(got.buffers()[1], np.int64)[np.concatenate([[0], 2 * np.cumsum(lens)])].tolist()
        data = memoryview(got.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


@cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian bytes).

    A document is its ids and the separator. Only longer ones than ``length``
    are cut. A null text is empty: one piece, the separator.
    """
    rows_per_batch(docs.sparkSession, 2048)
    most = 4 * length

    def run(batches):
        only_word_cache("encoder", encoder.cache_clear)
        encode = encoder(tokenizer).encode
        for whole in batches:
            for b in slices(whole, 1):
                doc, piece, start, size, crc, ids = [], [], [], [], [], []
                for d, got in zip(b.column(0).to_pylist(), encode(b.column(1))):
                    got += SEPARATOR.to_bytes(4, "little")
                    for i, at in enumerate(range(0, len(got), most)):
                        part = got[at : at + most]
                        doc.append(d)
                        piece.append(i)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


class _Line:
    """Pieces of falling length laid end to end; what holds for each follows from the counts of the lengths."""

    def __init__(self, counts: dict[int, int]):
        sizes = sorted((k for k, n in counts.items() if n), reverse=True)
        self.sizes, self.counts = np.array(sizes, np.int64), np.array([counts[k] for k in sizes], np.int64)
        self.index = np.cumsum(self.counts) - self.counts
        self.start = np.cumsum(self.counts * self.sizes) - self.counts * self.sizes
        self.n, self.tokens = int(self.counts.sum()), int((self.counts * self.sizes).sum())

    def place(self, size: np.ndarray) -> np.ndarray:
        """The place of the first piece of a length that is there."""
        return self.index[np.searchsorted(-self.sizes, -size)]

    def before(self, i: np.ndarray) -> np.ndarray:
        """Tokens before the piece at a place."""
        j = np.searchsorted(self.index, i, side="right") - 1
        return self.start[j] + (i - self.index[j]) * self.sizes[j]

    def first(self, x: np.ndarray) -> np.ndarray:
        """Where the first piece at or behind a token starts; all tokens if there is none."""
        j = np.searchsorted(self.start, x, side="right") - 1
        return np.minimum(self.start[j] - (self.start[j] - x) // self.sizes[j] * self.sizes[j], self.tokens)


class _Opened:
    """New sequences that take pieces by falling length, each as many as it holds: where each piece goes."""

    def __init__(self):
        self.index, self.first, self.each, self.gap, self.n = [], [], [], [], 0

    def open(self, counts: dict[int, int], capacity: int, at: int) -> int:
        """Adds pieces from place ``at``; runs of alike sequences are one entry."""
        left = 0  # room of the last sequence
        for size in sorted((k for k, n in counts.items() if n), reverse=True):
            n = counts[size]
            take = min(n, left // size)
            if take:
                self._split(take, take * size)
                at, n, left = at + take, n - take, left - take * size
            each = capacity // size
            for many, per in ((n // each, each), (1 if n % each else 0, n % each)):
                if many:
                    self.index.append(at)
                    self.first.append(self.n)
                    self.each.append(per)
                    self.gap.append(capacity - per * size)
                    self.n, at = self.n + many, at + many * per
                    left = capacity - per * size
        return at

    def _split(self, more: int, tokens: int) -> None:
        """Gives ``more`` pieces to the last sequence, which becomes an entry of its own."""
        if self.n - self.first[-1] > 1:
            last = self.n - 1
            self.index.append(self.index[-1] + (last - self.first[-1]) * self.each[-1])
            self.first.append(last)
            self.each.append(self.each[-1])
            self.gap.append(self.gap[-1])
        self.each[-1] += more
        self.gap[-1] -= tokens


def _tops(capacity: int) -> list[int]:
    """The longest lengths of the bands: pieces of the longest bands fit a sequence equally often."""
    return sorted({capacity // k for k in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 21, 32)} | {1 << i for i in range((capacity // 32).bit_length())} - {0}, reverse=True)


class _Step:
    """One superstep: keys that bring pieces (length, rank) and gaps (size, rank) together."""

    def __init__(self, gaps: dict[int, int], pieces: dict[int, int], used: dict[int, int], capacity: int):
        self.used, self.capacity, self.took = used, capacity, {}
        self.line = _Line(pieces)
        top = int(self.line.sizes[0])
        wide = sorted(g for g, n in gaps.items() if g >= 2 * top)
        self.fill = bool(wide)
        if self.fill:
            self.wide, many = np.array(wide), np.array([gaps[g] for g in wide])
            self.part = self.wide - top + 1  # a piece that starts in this part of the gap ends in the gap
            self.base, self.key = np.cumsum(self.part * many) - self.part * many, np.cumsum(many) - many
            self.end = int((self.part * many).sum())
            placed = self.line.n
            if self.end < self.line.tokens:
                start = self.line.first(np.array([self.end]))[0]
                j = int(np.searchsorted(self.line.start, start, side="right")) - 1
                placed = int(self.line.index[j] + (start - self.line.start[j]) // self.line.sizes[j])
            for size, n, i in zip(self.line.sizes.tolist(), self.line.counts.tolist(), self.line.index.tolist()):
                self.took[size] = min(n, max(0, placed - i))
        else:
            depth, turn, self.runs = 0, 0, {}
            for size in sorted({*gaps, *pieces}, reverse=True):
                if gaps.get(size):
                    self.runs["gap", size] = depth, turn
                    depth, turn = depth + gaps[size], turn + 1
                if pieces.get(size):
                    self.took[size] = min(pieces[size], depth)
                    self.runs["piece", size] = depth - 1, turn
                    depth, turn = depth - self.took[size], turn + 1
        self.matched = sum(self.took.values())
        table = lambda f: np.array([f(i) for i in range(capacity + 1)], np.int64)
        self._used, self._took = table(lambda i: used.get(i, 0)), table(lambda i: self.took.get(i, 0))
        if not self.fill:
            self._gap, self._piece = (table(lambda i, k=k: self.runs.get((k, i), (0, 0))[0]) for k in ("gap", "piece"))
            self._gap_turn, self._piece_turn = (table(lambda i, k=k: self.runs.get((k, i), (0, 0))[1]) for k in ("gap", "piece"))

    def keep(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which pieces this step places."""
        return (rank >= self._used[length]) & (rank < self._used[length] + self._took[length])

    def piece_keys(self, length: np.ndarray, rank: np.ndarray):
        """Key, turn in it, and place behind what the gap's sequence held."""
        rank = rank - self._used[length]
        if not self.fill:
            return self._piece[length] - rank, self._piece_turn[length], np.zeros(len(rank), np.int64)
        at = self.line.before(self.line.place(length) + rank)
        j = np.searchsorted(self.base, at, side="right") - 1
        nth = (at - self.base[j]) // self.part[j]
        return self.key[j] + nth, np.ones(len(rank), np.int64), at - self.line.first(self.base[j] + nth * self.part[j])

    def gap_keys(self, gap: np.ndarray, rank: np.ndarray, sequence: np.ndarray):
        """Key, turn in it, and tokens that the gap takes (-1: the next row's length, if it has one)."""
        if not self.fill:
            return self._gap[gap] + rank, self._gap_turn[gap], np.full(len(gap), -1)
        wide = gap >= self.wide[0]
        j = np.where(wide, np.searchsorted(self.wide, gap), 0)
        at = self.base[j] + np.where(wide, rank, 0) * self.part[j]
        took = self.line.first(np.minimum(at + self.part[j], self.end)) - self.line.first(at)
        return np.where(wide, self.key[j] + rank, -1 - sequence), np.zeros(len(gap), np.int64), np.where(wide, took, 0)


class _Ranks:
    """Rank within a size from a row's place in a table sorted by size, and rows per size."""

    def __init__(self, runs: list[tuple[int, int, int, int]]):
        """``runs``: part, size, rows, first place; at most one for each part and one for each size."""
        self.counts: dict[int, int] = {}
        keys, shifts = [], []
        for part, size, n, first in sorted(runs):
            keys.append(part << 20 | size)
            shifts.append(self.counts.get(size, 0) - first)
            self.counts[size] = self.counts.get(size, 0) + n
        self.keys, self.shifts = np.array(keys, np.int64), np.array(shifts, np.int64)

    def __call__(self, part: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at + self.shifts[np.searchsorted(self.keys, part.astype(np.int64) << 20 | size)]


def _sorted_by(df: DataFrame, size: str, *ties: str) -> DataFrame:
    """``df`` range-sorted by falling size, written, with each row's range and place; ties are split over ranges."""
    order = [F.desc(size), *ties]
    return stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def _ranks(table: DataFrame, size: str) -> _Ranks:
    runs = table.where(f"{size} is not null").groupBy("_part", size).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    return _Ranks([tuple(r) for r in runs.collect()])  # bounded by ranges + sizes


_GAP = "key long, turn long, sequence_id long, gap long, took long"
_PIECE = "key long, turn long, length long, rank long, inset long"


def _numbers(batch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _batch(columns, schema: str):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _matched(step: _Step, open_gaps: list[DataFrame], ranked: DataFrame, ranks: _Ranks, least: int) -> DataFrame:
    """Rows of one superstep: gaps that stay open (sequence_id, gap) and placed pieces (length, rank, sequence_id, offset)."""

    def of_pieces(batches):
        for b in batches:
            length, part, at = _numbers(b)
            rank = ranks(part, length, at)
            ok = step.keep(length, rank)
            length, rank = length[ok], rank[ok]
            key, turn, inset = step.piece_keys(length, rank)
            yield _batch((key, turn, length, rank, inset), _PIECE)

    lo, hi = min(step.took), max(step.took)
    pieces = ranked.where(F.col("length").between(lo, hi)).select("length", "_part", "_at").mapInArrow(of_pieces, _PIECE)
    rows = pieces
    for gaps in open_gaps:
        rows = rows.unionByName(gaps, allowMissingColumns=True)
    along = Window.partitionBy("key").orderBy("turn")
    # The rows of a key: gap, its pieces, another gap, ...; at most two for each size, or one gap and what it holds.
    home = F.last("sequence_id", True).over(along)
    room = F.last("gap", True).over(along)
    follows = F.coalesce(F.lead("length").over(along), F.lit(0))
    took = F.when(F.col("took") < 0, follows).otherwise(F.col("took"))
    placed = rows.select("length", "rank", home.alias("sequence_id"), (F.lit(step.capacity) - room + F.col("inset")).alias("offset"), (F.col("gap") - took).alias("gap"))
    return placed.where(F.col("length").isNotNull() | (F.col("gap") >= least))


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` -> the same rows with sequence_id (from 0, without gaps) and offset in the sequence.

    No piece may be longer than ``length``. The gaps of a superstep are written
    and read again, so a lost executor costs its own tasks only.
    """
    spark = found.sparkSession
    taken = stage(found)
    ranked = _sorted_by(taken.withColumn("tie", row_tie()), "length", "doc_id", "piece", "tie")
    drop_stage(taken)
    ranks = _ranks(ranked, "length")
    left, used = dict(ranks.counts), {}
    opened, at = _Opened(), 0
    opened_from: dict[int, tuple[int, int]] = {}  # length -> rank of its first opened piece, place of that piece
    steps: list[DataFrame] = []  # placed pieces
    state, fresh = None, 0  # gaps of the last superstep; entries of ``opened`` that it has seen
    gap_ranks = _Ranks([])
    tops = _tops(length)
    for top, low in zip(tops, [*tops[1:], 0]):
        while band := {k: n for k, n in left.items() if low < k <= top and n}:
            firsts, ends = opened.first[fresh:], [*opened.first[fresh + 1 :], opened.n]
            counts = dict(gap_ranks.counts)
            before = []
            for gap, first, end in zip(opened.gap[fresh:], firsts, ends):
                before.append(counts.get(gap, 0))
                counts[gap] = counts.get(gap, 0) + end - first
            step = _Step({g: n for g, n in counts.items() if g}, band, used, length)
            if not step.matched:
                rest, at = at, opened.open(band, length, at)
                for k in sorted(band, reverse=True):
                    opened_from[k] = used.get(k, 0), rest
                    rest, left[k] = rest + band[k], 0
                break
            for k, n in step.took.items():
                used[k], left[k] = used.get(k, 0) + n, left[k] - n
            open_gaps = []
            if state is not None:

                def of_gaps(batches, step=step, gap_ranks=gap_ranks):
                    for b in batches:
                        sequence, gap, part, place = _numbers(b)
                        key, turn, took = step.gap_keys(gap, gap_ranks(part, gap, place), sequence)
                        yield _batch((key, turn, sequence, gap, took), _GAP)

                open_gaps.append(state.where("gap is not null").select("sequence_id", "gap", "_part", "_at").mapInArrow(of_gaps, _GAP))
            if firsts and ends[-1] > firsts[0]:
                table = [np.array(x, np.int64) for x in (firsts, opened.gap[fresh:], before)]

                def of_new(batches, step=step, table=table):
                    first, gaps, ahead = table
                    for b in batches:
                        (sequence,) = _numbers(b)
                        j = np.searchsorted(first, sequence, side="right") - 1
                        ok = gaps[j] > 0
                        sequence, j = sequence[ok], j[ok]
                        key, turn, took = step.gap_keys(gaps[j], sequence - first[j] + ahead[j], sequence)
                        yield _batch((key, turn, sequence, gaps[j], took), _GAP)

                open_gaps.append(spark.range(firsts[0], ends[-1]).mapInArrow(of_new, _GAP))
            fresh = len(opened.first)
            least = min((k for k, n in left.items() if n), default=length + 1)
            state = _sorted_by(_matched(step, open_gaps, ranked, ranks, least), "gap", "sequence_id", "length", "rank")
            steps.append(state.where("length is not null").select("length", "rank", "sequence_id", "offset"))
            gap_ranks = _ranks(state, "gap")
    return _placed(ranked, ranks, opened, opened_from, steps, found.columns)


def _placed(ranked: DataFrame, ranks: _Ranks, opened: _Opened, opened_from: dict[int, tuple[int, int]], steps: list[DataFrame], columns: list[str]) -> DataFrame:
    """Every piece with its place: opened sequences by counting, the others as the supersteps found."""
    most = max(ranks.counts, default=0) + 1
    since, index = np.full(most, np.iinfo(np.int64).max), np.zeros(most, np.int64)
    for k, (rank, place) in opened_from.items():
        since[k], index[k] = rank, place
    line = _Line({k: ranks.counts[k] - r for k, (r, _) in opened_from.items()})
    starts, firsts, each = (np.array(x, np.int64) for x in (opened.index, opened.first, opened.each))

    def where(batches):
        for b in batches:
            size, part, at = _numbers(b.select(["length", "_part", "_at"]))
            rank = ranks(part, size, at)
            new = rank >= since[size]
            i = (index[size] + rank - since[size])[new]
            j = np.searchsorted(starts, i, side="right") - 1
            nth = (i - starts[j]) // each[j] if len(i) else i
            sequence, offset = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
            if len(i):
                sequence[new] = firsts[j] + nth
                offset[new] = line.before(i) - line.before(starts[j] + nth * each[j])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (rank, sequence, offset))], names=[*b.schema.names, "rank", "sequence_id", "offset"])

    schema = StructType(ranked.schema.fields + StructType.fromDDL("rank long, sequence_id long, offset long").fields)
    known = ranked.mapInArrow(where, schema)
    out = known.where("sequence_id >= 0").select(*columns, "sequence_id", "offset")
    if steps:
        matched = steps[0]
        for x in steps[1:]:
            matched = matched.union(x)
        rest = known.where("sequence_id < 0").drop("sequence_id", "offset")
        out = out.union(rest.join(matched, ["length", "rank"]).select(*columns, "sequence_id", "offset"))
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> (sequence_id, ids): the token ids of every sequence, as bytes.

    A sequence holds at most ``LENGTH`` tokens, so its group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts give one piece of one separator. Repeated rows and null
    doc_ids are packed like any other row. An empty table gives an empty one.
    """
    return pack(pieces(docs, tokenizer, length), length)
