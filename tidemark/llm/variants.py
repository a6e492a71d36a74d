"""Spelling variants: words that differ by one sign, found in a trie of letter-group counts.

Letters are dealt into ``GROUPS`` groups of about equal weight; a word's path is
how often it has letters of each group, one group after the other. Replacing a
letter adds one to a group and takes one from another, inserting adds one. So the
words near a word lie on paths with at most one surplus and one deficit, and a
depth-first search of the trie of paths spends one of each; the words where it
ends are verified. Of two near words the one with the smaller path searches, so
the surplus comes first.

The trie is cut at the depth where no node holds more than ``NODE`` words: nodes
are searched one by one, and a word goes to the nodes that its budget reaches at
this depth. If more words share a whole path, they are told apart by halves: near
words share the first half of the shorter one, or its second half.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stage, rows_per_batch, slices, stage

GROUPS, NODE = 20, 8192
LEAST_LETTERS, LEAST_COUNT, EVERY = 5, 3, 97

_RUNS = re.compile("[a-z\\u00c0-\\u00ff]+").findall  # of texts in lower case
_CROWD = 64  # pairs of words that are compared one by one


def _prefix_sums(ids: list, byte_lens: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """What the crc32 of ``<doc_id>:`` adds to the crc32 of the bytes behind it: it depends on how many there are."""
    width = int(byte_lens.max()) + 1
    pairs, at = np.unique(doc_of * width + byte_lens, return_inverse=True)
    zeros, sums = bytes(width), [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    alone = {n: zlib.crc32(zeros[:n]) for n in np.unique(pairs % width).tolist()}
    return np.array([zlib.crc32(zeros[:n], sums[d]) ^ alone[n] for d, n in (divmod(p, width) for p in pairs.tolist())], np.uint32)[at]


def _counted(ids: list, texts: list[str | None], counts: dict[str, int]) -> None:
    """Adds the words of some texts to ``counts``."""
    runs = [_RUNS(t.encode().lower().decode()) if t else [] for t in texts]
    flat = pa.array([w for r in runs for w in r], pa.string()).dictionary_encode()
    if not len(flat):
        return
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_pylist()
    # Once for each text and distinct run.
    cells, times = np.unique(np.repeat(np.arange(len(texts)), [len(r) for r in runs]) * len(words) + codes, return_counts=True)
    doc_of, codes = np.divmod(cells, len(words))
    h = _prefix_sums(ids, pc.binary_length(flat.dictionary).to_numpy()[codes].astype(np.int64), doc_of)
    h ^= np.array([zlib.crc32(w.encode()) for w in words], np.uint32)[codes]
    cut = h % EVERY == 0
    whole = np.bincount(codes[~cut], times[~cut], len(words)).astype(np.int64)
    for w, n in zip(words, whole.tolist()):
        if n and len(w) >= LEAST_LETTERS:
            counts[w] += n
    for c, x, n in zip(codes[cut].tolist(), h[cut].tolist(), times[cut].tolist()):
        w = words[c]
        if len(w) > LEAST_LETTERS:
            at = x % len(w)
            counts[w[:at] + w[at + 1 :]] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> word, n: the distinct words of all texts, with the letters that checksums delete deleted."""
    rows_per_batch(docs.sparkSession, 2048)

    def run(batches):
        counts: dict[str, int] = defaultdict(int)
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for whole in batches:
            for b in slices(whole, 1):
                _counted(b.column(0).to_pylist(), b.column(1).to_pylist(), counts)
                if len(counts) > 200_000:
                    yield made()
                    counts.clear()
        yield made()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """Letter -> group: by falling frequency, each into the lightest group. There are at most 90 letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    weight, out = [0] * groups, {}
    for letter, n in sorted(((r["letter"], r["n"]) for r in letters.where("letter <> ''").collect()), key=lambda x: (-x[1], x[0])):
        lightest = weight.index(min(weight))
        out[letter] = lightest
        weight[lightest] += n
    return out


def with_paths(words: DataFrame, group: dict[str, int], groups: int = GROUPS) -> DataFrame:
    """``words`` with their path, counts joined by points."""
    signs = str.maketrans({c: chr(33 + g) for c, g in group.items()})
    names = [chr(33 + g) for g in range(groups)]

    def run(batches):
        for b in batches:
            coded = [w.translate(signs) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([".".join([str(w.count(s)) for s in names]) for w in coded], pa.string())], names=["word", "n", "path"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, path string")


def _reached(path: list[int], depth: int):
    """(node, left): paths of ``depth`` counts that a word's budget reaches beyond its own; left is whether the deficit is unspent."""
    own = path[:depth]
    for i in range(depth):
        own[i] += 1
        yield ".".join(map(str, own)), True
        for j in range(i + 1, depth):
            if own[j]:
                own[j] -= 1
                yield ".".join(map(str, own)), False
                own[j] += 1
        own[i] -= 1


def _halves(word: str, searching: bool) -> set[str]:
    """The halves by which a word searches, or is found by words of its length and shorter ones."""
    out = set()
    for n in (len(word),) if searching else (len(word), len(word) - 1):
        out |= {"<" + word[: n // 2], ">" + word[len(word) - (n - n // 2) :]}
    return out


def _sent(depth: int, halves: bool):
    """(word, n, path) -> (node, word, n, path, kind): the node that holds a word (0), and those it searches with (1) or without (2) a deficit left."""

    def run(batches):
        for b in batches:
            rows = []
            for word, n, path in zip(*(c.to_pylist() for c in b.columns)):
                counts = list(map(int, path.split(".")))
                at = [(".".join(map(str, counts[:depth])), 0), *((node, 1 if left else 2) for node, left in _reached(counts, depth))]
                if halves:
                    held, search = _halves(word, False), _halves(word, True)
                    # The own path is searched too: words there meet by halves only.
                    at = [(f"{node}{half}", kind) for node, kind in [*at, (at[0][0], 2)] for half in (search if kind else held)]
                rows += [(node, word, n, path, kind) for node, kind in at]
            for lo in range(0, len(rows), 50_000):
                node, word, n, path, kind = zip(*rows[lo : lo + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(path, pa.string()), pa.array(kind, pa.int32())], names=["node", "word", "n", "path", "kind"])

    return run


def near(x: str, y: str) -> bool:
    """Whether one replaced or inserted sign turns ``x`` into ``y``."""
    n, more = len(x), len(y) - len(x)
    h = n // 2
    if x == y or not 0 <= more <= 1 or (x[:h] != y[:h] and x[h:] != y[h + more :]):
        return False
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), n)
    return x[at + 1 - more :] == y[at + 1 :]


class _Search:
    """Depth-first search of words (path, word, n) against the words of one node; near pairs are added to ``found``."""

    def __init__(self, halves: bool):
        self.found: list[tuple] = []
        self.halves = halves

    def _split(self, node, depth: int) -> dict:
        if isinstance(node, dict):
            return node
        out = defaultdict(list)
        for item in node:
            out[item[0][depth]].append(item)
        return out

    def trie(self, items: list, depth: int):
        """Counts to nodes, level by level; few words stay a list."""
        if len(items) <= 8 or depth == len(items[0][0]):
            return items
        return {count: self.trie(part, depth + 1) for count, part in self._split(items, depth).items()}

    def _pair(self, x, y) -> None:
        if x[:2] < y[:2] and near(x[1], y[1]):
            if self.halves:  # a pair that shares both halves is found twice
                h = len(x[1]) // 2
                if self.half == ">" and x[1][:h] == y[1][:h]:
                    return
            self.found.append((x, y))

    def _compare(self, a: list, b: list) -> None:
        if len(a) * len(b) <= _CROWD:
            for x in a:
                for y in b:
                    self._pair(x, y)
            return
        less = defaultdict(list)  # words of b by what is left without one of their signs
        for y in b:
            w = y[1]
            for i in range(len(w)):
                less[w[:i] + w[i + 1 :]].append((i, y))
        for x in a:
            w = x[1]
            # Of equal neighbouring signs any may go: each word is met once.
            for y in {y[1]: y for _, y in less.get(w, ())}.values():
                self._pair(x, y)
            for i in range(len(w)):
                for j, y in less.get(w[:i] + w[i + 1 :], ()):
                    if i == j and len(y[1]) == len(w):
                        self._pair(x, y)

    def run(self, a, b, depth: int, surplus: bool, deficit: bool) -> None:
        """Words of ``a`` that search node ``b`` with what is left of their budget; both stand at ``depth``."""
        if isinstance(a, list) and isinstance(b, list) and (len(a) * len(b) <= _CROWD or depth == len(a[0][0])):
            self._compare(a, b)
            return
        a, b = self._split(a, depth), self._split(b, depth)
        for count, part in a.items():
            if count in b:
                self.run(part, b[count], depth + 1, surplus, deficit)
            if surplus and count + 1 in b:
                self.run(part, b[count + 1], depth + 1, False, deficit)
            if deficit and not surplus and count - 1 in b:
                self.run(part, b[count - 1], depth + 1, surplus, False)


def _searched(depth: int, halves: bool):
    """The rows of one node -> (word, other, other_n) of near words, each pair both ways."""

    def run(rows: pa.Table) -> pa.Table:
        kinds: dict[int, list] = {0: [], 1: [], 2: []}
        for word, n, path, kind in zip(*(rows[c].to_pylist() for c in ("word", "n", "path", "kind"))):
            kinds[kind].append((tuple(map(int, path.split("."))), word, n))
        held, search = kinds[0], _Search(halves)
        if held:
            if halves:
                node = rows["node"][0].as_py()
                search.half = next(c for c in node if c in "<>")
                search._compare(kinds[1] + kinds[2], held)
            else:
                trie = search.trie(held, depth)
                search.run(trie, trie, depth, True, True)
                for kind in (1, 2):
                    if kinds[kind]:
                        search.run(search.trie(kinds[kind], depth), trie, depth, False, kind == 1)
        word = [w for x, y in search.found for w in (x[1], y[1])]
        other = [w for x, y in search.found for w in (y[1], x[1])]
        n = [k for x, y in search.found for k in (y[2], x[2])]
        return pa.table([pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(n, pa.int64())], names=["word", "other", "other_n"])

    return run


def near_pairs(words: DataFrame, groups: int = GROUPS, node: int = NODE) -> DataFrame:
    """(word, n; written) -> (word, other, other_n): all near words, each pair both ways."""
    paths = stage(with_paths(words, letter_groups(words, groups), groups))
    largest, depth = node + 1, 0
    while largest > node and depth < groups:
        depth += 1
        largest = paths.groupBy(F.substring_index("path", ".", depth)).count().agg(F.max("count")).first()[0] or 0
    halves = largest > node
    sent = paths.mapInArrow(_sent(depth, halves), "node string, word string, n long, path string, kind int")
    return sent.groupBy("node").applyInArrow(_searched(depth, halves), "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last. Counts double from form to form, so 6 doublings reach any root."""
    known = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(8):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, known = known, stage(moved)
        drop_stage(before)
        if not known.where("moved").limit(1).count():
            break
    return known.select("word", "root")


def spelling_variants(docs: DataFrame, groups: int = GROUPS, node: int = NODE) -> DataFrame:
    """(doc_id, text) -> word, n, n_near, form, form_n and root of every word.

    A null or empty text has no words. A null doc_id counts as an empty one in
    the checksum; repeated rows are counted each. Texts and words of any length
    are read whole. Of near words with equal n the first in code-point order is
    the form. Other columns are ignored; an empty table gives an empty one.
    """
    words = stage(word_counts(docs))
    pairs = near_pairs(words, groups, node)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.k") >= 2 * F.col("n")
    rows = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n")))
    found = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
