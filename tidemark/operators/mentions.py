"""Entities mentioned in documents: an index of words finds the candidates, the words' places in a text judge them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tidemark.functions import text as T

#: Signals from the strongest to the weakest.
SIGNALS = ("HOT", "WARM", "UNKNOWN", "CLEAR")

_NO_WORD = r"[^\p{L}\p{Nd}_]+"
_BOUNDARY = r"\b"
# What explains a mention, as ``mention_signal`` has it: a vice within so many characters before, or a title with its dot.
_VICE, _VICE_SPAN, _TITLES, _DOT = "vice", 40, ("Mr", "Mrs", "Ms", "Messrs", "Mses"), r"\.[ \t\n\x0b\f\r]{0,3}"
#: Tokens and occurrences that are looked at together.
_TOGETHER = 1 << 20


def words(text: Column) -> Column:
    """The distinct words of a text, and the empty one."""
    return F.array_distinct(F.concat(F.split(text, _NO_WORD), F.array(F.lit(""))))


def term(entity: Column) -> Column:
    """The word by which an entity is looked up: the longest of its last name; a name without letters has the empty one."""
    parts = F.split(T.last_name(entity), _NO_WORD)
    return F.aggregate(parts, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def _one_token(name: Column) -> Column:
    """Whether a name is a single word between two boundaries, so that texts have it as one token or not at all."""
    return (F.regexp_count(name, F.lit(_BOUNDARY)) == 2) & name.rlike(r"\A\b") & name.rlike(r"\b\z")


class _Places:
    """Where the tokens of some texts are: by code, then by place."""

    def __init__(self, code: np.ndarray, counts: np.ndarray, length: np.ndarray):
        self.code, self.n = code, len(code) + 1
        self.doc_end = np.cumsum(counts)
        self.doc_start = self.doc_end - counts
        self.end = np.cumsum(length[code])  # in characters
        self.begin = self.end - length[code]
        self.order = np.argsort(code, kind="stable")
        self.sorted = code[self.order] * self.n + self.order

    def span(self, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of ``order`` that holds the places of a code in a text."""
        return np.searchsorted(self.sorted, code * self.n + self.doc_start[doc]), np.searchsorted(self.sorted, code * self.n + self.doc_end[doc])

    def within(self, code: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
        """Whether the code's last token before ``at`` is in the same text and ends at most ``span`` characters before it."""
        if not len(self.sorted):
            return np.zeros(len(at), bool)
        i = np.searchsorted(self.sorted, code * self.n + at) - 1
        found = self.sorted[np.maximum(i, 0)]
        place = found % self.n
        return (i >= 0) & (found // self.n == code) & (place >= self.doc_start[doc]) & (self.begin[at] - self.end[place] <= span)


def _left(places: _Places, last: int, at: np.ndarray, titled: np.ndarray, vice: np.ndarray) -> bool:
    """Whether a mention is left when the explained ones are cut out from left to right, each as long as it can be."""
    starts = sorted([(int(v), True) for v in vice] + [(int(x) - 2, False) for x in at[titled]])
    gone, free = np.zeros(len(at), bool), 0
    for start, is_vice in starts:
        if start < free:
            continue
        if is_vice:
            reached = at[(at > start) & (places.begin[at] - places.end[start] <= _VICE_SPAN)]
            if not len(reached):
                continue
            stop = int(reached[-1])
        else:
            stop = start + 2
        gone |= (at >= start) & (at <= stop)
        free = stop + 1
    return not gone.all()


def _signals(batch: pa.RecordBatch, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (text, name in its list, counted over all lists) of a batch that have a signal, and its place in SIGNALS."""
    names, tokens, section = (batch.column(c) for c in ("names", "tokens", "section"))
    counts = lambda column: pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, last = names.flatten().flatten()
    columns = [tokens.flatten(), section.flatten(), first, last, pa.array([_VICE], pa.string())]
    coded = pa.concat_arrays([c.cast(pa.string()) for c in columns]).dictionary_encode()
    vocabulary = coded.dictionary
    code, in_section, first, last, vice = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])
    at = _Places(code, counts(tokens), pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64))
    is_title = pc.is_in(vocabulary, pa.array(_TITLES)).to_numpy(zero_copy_only=False)
    is_dot = np.zeros(len(vocabulary), bool)
    dotted = np.flatnonzero(pc.starts_with(vocabulary, ".").to_numpy(zero_copy_only=False))
    is_dot[dotted] = [re.fullmatch(_DOT, vocabulary[int(i)].as_py()) is not None for i in dotted]
    marks = is_title.copy()
    marks[vice] = True

    per = counts(names)
    doc = np.repeat(np.arange(len(per)), per)
    lo, hi = at.span(last, doc)
    full, free = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    upto = np.cumsum(hi - lo)
    a = 0
    while a < len(doc):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + _TOGETHER, side="right")))
        n = (hi - lo)[a:b]
        pair = np.repeat(np.arange(a, b), n)
        place = at.order[np.arange(len(pair)) - np.repeat(upto[a:b] - n - done, n) + lo[pair]]
        full[pair[(first[pair] == last[pair]) | at.within(first[pair], place, doc[pair], near)]] = True
        titled = (place - at.doc_start[doc[pair]] >= 2) & is_title[code[place - 2]] & is_dot[code[place - 1]]
        explained = titled | at.within(np.broadcast_to(vice, len(pair)), place, doc[pair], _VICE_SPAN)
        free[pair[~explained & ~marks[last[pair]]]] = True
        a = b
    rank = np.full(len(doc), 3)
    rank[free] = 2
    # All mentions may be explained: which are depends on those before them.
    for i in np.flatnonzero(~full & ~free & (hi > lo)):
        place = at.order[lo[i] : hi[i]]
        titled = (place - at.doc_start[doc[i]] >= 2) & is_title[code[place - 2]] & is_dot[code[place - 1]]
        v = at.order[slice(*(int(x[0]) for x in at.span(vice, doc[i : i + 1])))]
        rank[i] = 2 if _left(at, int(last[i]), place, titled, v) else 3
    sections = counts(section)
    seen = np.repeat(np.arange(len(sections)), sections) * len(vocabulary) + in_section
    rank[full] = np.where(np.isin(doc[full] * len(vocabulary) + last[full], seen), 0, 1)
    told = np.flatnonzero(rank < 3)
    return told, rank[told]


def _judge(near: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parts(batch):
        n = pc.list_value_length(batch.column("tokens")).to_pylist()
        at = total = 0
        for i, k in enumerate(n):
            if total and total + k > _TOGETHER:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += k
        if at < len(n):
            yield batch.slice(at)

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                told, rank = _signals(part, near)
                names = part.column("names")
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(names).to_numpy(zero_copy_only=False))
                columns = [part.column("doc_id").take(pa.array(doc[told])), names.flatten().flatten()[0].take(pa.array(told)), pa.array(SIGNALS).take(pa.array(rank))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def mentions(docs: DataFrame, entities: DataFrame, section_word: str = "cloture", span: int = 4000, near: int = 40) -> DataFrame:
    """(doc_id, text) and (entity) -> doc_id, entity, signal of all pairs whose document holds the entity's last name and whose signal is not CLEAR.

    Documents go to (word, doc_id) rows that meet entities by an equi-join, and the
    names of a document become one list, which is joined to its text. A text is cut
    into tokens once, at the word boundaries of ``mention_signal``'s patterns; where
    the tokens are tells the signals of all its names. Names that are more than a
    word to these patterns (O'Neil) are few; their texts are searched by pattern,
    a pair at a time. Every other pair of a text and an entity is CLEAR. Documents
    without a text or id and empty entities have no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    known = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    names = entities.where(F.trim("entity") != "").select("entity").distinct()
    names = names.withColumns({"word": term(F.col("entity")), "first": F.split(F.trim("entity"), r"\s+")[0], "last": T.last_name(F.col("entity"))}).withColumn("plain", _one_token(F.col("first")) & _one_token(F.col("last")))
    index = known.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    pairs = lambda plain: index.join(names.where(F.col("plain") == plain), "word")

    lists = pairs(True).groupBy("doc_id").agg(F.collect_set(F.struct("entity", "first", "last")).alias("names"))
    cut = lambda c: F.coalesce(F.split(c, _BOUNDARY), F.array().cast("array<string>"))
    section = F.array_distinct(cut(T.marked_section(F.col("text"), section_word, span)))
    schema = K.StructType([known.schema["doc_id"], K.StructField("entity", K.StringType()), K.StructField("signal", K.StringType())])
    told = known.join(lists, "doc_id").select("doc_id", "names", cut(F.col("text")).alias("tokens"), section.alias("section")).mapInArrow(_judge(near, to_arrow_schema(schema)), schema)

    signal = T.mention_signal(F.col("entity"), F.col("text"), section_word, span, near).alias("signal")
    searched = known.join(pairs(False).select("doc_id", "entity").distinct(), "doc_id").select("doc_id", "entity", signal).where("signal <> 'CLEAR'")
    return told.unionByName(searched)


def mention_features(found: DataFrame, entities: DataFrame, checked: Column, source: str = "documents") -> DataFrame:
    """The strongest signal of each entity as a point-in-time feature known when it was ``checked``; the evidence is the first document that has it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("signal"))
    best = found.groupBy("entity").agg(F.min(F.struct(rank.alias("rank"), "doc_id", "signal")).alias("best"))
    every = entities.where(F.trim("entity") != "").select("entity").distinct().join(best, "entity", "left")
    at = checked.cast("timestamp")
    return every.select(
        F.lit(source).alias("source"), "entity", F.lit("mention").alias("metric"), at.alias("effective_at"), at.alias("available_at"), at.alias("retrieved_at"),
        F.coalesce("best.signal", F.lit("CLEAR")).alias("value"), F.lit("").alias("revision"), F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")).alias("evidence"),
    )
