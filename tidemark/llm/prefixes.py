"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix is that of a shorter one and one more token: the only
token ending there that merges can leave standing beside the last token of the
shorter prefix. So a pass over the bytes of a piece gives the exact count at
each of its prefixes, and no prefix is encoded again. Pieces are those of the
tokenizer's own pre-tokenizer; counts of pieces add up. Where a prefix is cut
differently than the whole text (in white space before a word, in a contraction,
in a special string), its count is worked out for the cut it has.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import cache
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import only_word_cache, rows_per_batch, slices

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Code points of a row of stored counts.
BLOCK = 4096

_NEVER = sys.maxsize
#: Contractions of three signs that the pre-tokenizer keeps whole; their first two signs alone are two pieces.
_LONG_CONTRACTIONS = {"'re", "'ve", "'ll"}
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
#: Plain letters and signs (no apostrophe): a run of these is a piece if nothing that may belong to it follows.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r'.,;:!?%&$*#"()\-'


def byte_signs() -> dict[str, str]:
    """The printable sign that stands for a byte in the vocabulary -> the byte: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Unit of a text -> differences of the counts at its prefixes, as 16-bit numbers.

    A unit is a plain word with the space before it, a run of plain signs, or
    white space and all that follows up to the next white space; it holds whole
    pieces whatever stands around it. The dictionary keeps short units and
    forgets everything when full. ``counter`` shares one between the tasks of a
    worker.
    """

    def __init__(self, file: str, most: int = 700_000):
        super().__init__()
        from tokenizers import Tokenizer

        plain = json.load(open(file, encoding="utf-8"))
        before, model = plain["pre_tokenizer"] or {}, plain["model"]
        if plain["normalizer"] or before.get("type") != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{file} is not a plain byte-level pair encoding")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in plain["added_tokens"]):
            raise ValueError(f"{file} has added tokens that take signs around them")
        self.most, self.cut = most, Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        vocabulary, signs = model["vocab"], byte_signs()
        self.special = [t["content"] for t in plain["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.rank, self.parts = {}, {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = vocabulary[a], vocabulary[b]
            self.rank[pair] = n
            self.parts[vocabulary[a + b]] = pair
        self.edges: tuple[dict, dict] = {}, {}
        self.sound: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for t, i in vocabulary.items():
            if t not in self.special and self._stands(i):
                self.tokens.add_word("".join([signs[c] for c in t]), (len(t), i << 32))
        self.tokens.make_automaton()
        white = "".join(re.escape(c) for c in _SPACES if len(self.cut(f"!{c}!")) > 1)
        word, signs = f" ?[{_LETTERS}]+", f"[{_SIGNS}]+"
        plain = f"{word}(?=[{white}{_SIGNS}'0-9]|\\Z)|{signs}(?=[{white}{_LETTERS}0-9]|\\Z)|\n(?=[{_LETTERS}])"
        self.units = re.compile(f"{plain}|[{white}]*[^{white}]+|[{white}]+").findall
        self.plain = re.compile(f"{word}|{signs}|\n").fullmatch
        self.white = re.compile(f"[{white}]*")
        self.beside: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token at an end of a token, from a byte up to the whole, each with the rank of the merge that it enters."""
        known = self.edges[side].get(token)
        if known is None:
            whole, known = token, [(token, _NEVER)]
            while pair := self.parts.get(token):
                known.append((pair[side], self.rank[pair]))
                token = pair[side]
            known = self.edges[side][whole] = known[::-1]
        return known

    def _met(self, a: int, b: int) -> tuple[int, int] | None:
        """What is merged first over the boundary of two tokens; None if nothing ever is.

        Merges go by rank, of equal ones the left first, so a merge over the
        boundary comes after one of the same rank in ``a``.
        """
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        rank = self.rank.get
        while True:
            (x, grows), (y, other) = left[i], right[j]
            over = rank((x, y), _NEVER)
            if over < grows and over <= other:
                return x, y
            if grows == other == _NEVER:
                return None
            if grows <= other:
                i += 1
            else:
                j += 1

    def _stands(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        found = self.sound.get(token)
        if found is None:
            pair = self.parts.get(token)
            found = self.sound[token] = pair is None or (self._stands(pair[0]) and self._stands(pair[1]) and self._met(*pair) == pair)
        return found

    def counts(self, piece: str) -> list[int]:
        """The count at every prefix of a piece, in code points."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        count, last, beside = [0] * (len(data) + 1), [0] * (len(data) + 1), self.beside
        for at, (n, token) in self.tokens.iter(data):
            end = at + 1
            if count[end]:
                continue
            start = end - n
            if start:
                pair = last[start] | token
                apart = beside.get(pair)
                if apart is None:
                    if len(beside) >= self.most:
                        beside.clear()
                    apart = beside[pair] = self._met(last[start], token >> 32) is None
                if not apart:
                    continue
            count[end], last[end] = count[start] + 1, token >> 32
        if len(data) == len(piece):
            return count[1:]
        return [count[e] for e in accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in piece)]

    def _counted(self, unit: str) -> list[int]:
        """The count at every prefix of a unit, in code points."""
        if self.plain(unit):
            return self.counts(unit)
        out, base = [], 0
        for _, (start, end) in self.cut(unit):
            out += [base + n for n in self.counts(unit[start:end])]
            if unit[start:end] in _LONG_CONTRACTIONS:
                out[-2] = base + 2
            base = out[-1]
        n = self.white.match(unit).end()
        if 1 < n < len(unit):  # the last white sign goes with the word only once there is a word
            out[n - 1] = self.counts(unit[:n])[-1]
        return out

    def __missing__(self, unit: str) -> bytes:
        count = self._counted(unit)
        made = array("h", map(sub, count, [0, *count])).tobytes()
        if len(unit) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[unit] = made
        return made

    def differences(self, text: str) -> np.ndarray:
        """By code point, how the count changes when the prefix grows by it."""
        parts = self.split(text)
        if len(parts) == 1:
            return np.frombuffer(b"".join(map(self.__getitem__, self.units(text))), np.int16)
        out = []
        for plain, special in zip(parts[::2], [*parts[1::2], ""]):
            units = self.units(plain)
            out += map(self.__getitem__, units)
            if special:  # as long as it is not whole, it is plain text that goes on from the last unit
                tail = units[-1] if units else ""
                cut = self._counted(tail + special)[len(tail) : -1]
                whole = sum(array("h", self[tail])) if tail else 0
                run = [whole, *cut, whole + 1]
                out.append(array("h", map(sub, run[1:], run)).tobytes())
        return np.frombuffer(b"".join(out), np.int16)


@cache
def counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def _per_text(docs: DataFrame, tokenizer: str, schema: str, rows) -> DataFrame:
    """``rows(ids, texts, differences)`` makes the columns of ``schema`` for each batch."""
    rows_per_batch(docs.sparkSession, 2048)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        only_word_cache("prefix counts", counter.cache_clear)
        known = counter(tokenizer)
        for whole in batches:
            for b in slices(whole, 1):
                texts = pc.fill_null(b.column(1).cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays(rows(b.column(0), texts, map(known.differences, texts.to_pylist())), names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit and fits_chars: code points of the longest prefix of at most ``limit`` tokens.

    A null text is empty: no bytes, no tokens. Texts of any length are read
    whole; each row is counted by itself, so repeated rows and ids, and rows
    without an id, have a row each. Other columns are ignored; an empty table
    gives an empty one.
    """

    def rows(ids, texts, found):
        tokens, fits = [], []
        for d in found:
            n = int(d.sum(dtype=np.int64))
            tokens.append(n)
            if n <= limit:
                fits.append(len(d))
            else:
                within = np.flatnonzero(np.cumsum(d, dtype=np.int64) <= limit)
                fits.append(int(within[-1]) + 1 if len(within) else 0)
        n = pa.array(tokens, pa.int64())
        return [ids, pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit), pa.array(fits, pa.int64())]

    return _per_text(docs, tokenizer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long", rows)


def prefix_counts(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> doc_id, block, counts: the token count at every prefix.

    ``counts[i]`` of block b is the count of the first ``b * block + i`` code
    points; a row holds ``block`` prefixes, so that a long text is many rows. An
    empty or null text is one row with the count 0. Written as a table, it
    answers ``tokens_at`` and ``longest_within`` without the text.
    """

    def rows(ids, texts, found):
        doc, at, counts = [], [], []
        for i, d in zip(ids.to_pylist(), found):
            count = np.concatenate([np.zeros(1, np.int64), np.cumsum(d, dtype=np.int64)])
            for n in range(0, len(count), block):
                doc.append(i)
                at.append(n // block)
                counts.append(count[n : n + block])
        return [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]

    return _per_text(docs, tokenizer, "doc_id long, block long, counts array<long>", rows)


def tokens_at(stored: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, at) -> doc_id, at, n_tokens of the first ``at`` code points; null where the text is shorter, unknown ids go.

    A question meets one stored row, of at most ``block`` counts. With repeated ids there is an answer for each text that has the row.
    """
    asked = questions.select("doc_id", "at", F.floor(F.col("at") / block).cast("long").alias("block"))
    return asked.join(stored, ["doc_id", "block"]).select("doc_id", "at", F.get("counts", (F.col("at") % block).cast("int")).alias("n_tokens"))


def longest_within(stored: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """doc_id, chars: the longest prefix of at most ``budget`` tokens. A longer prefix can have fewer tokens, so all are looked at."""
    last = F.size("counts") - F.array_position(F.transform(F.reverse("counts"), lambda n: n <= budget), True)
    best = F.when(F.exists("counts", lambda n: n <= budget), F.col("block") * block + last)
    return stored.select("doc_id", best.alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
