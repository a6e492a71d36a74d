"""Secrets by patterns and by a battery of randomness tests.

DataFrame functions only. Three base patterns are always reported. Beyond them,
runs of 20 or more token characters are tested against the hypothesis that they
are ordinary text in their inferred encoding (hex, decimal, letters, base32,
base36 or base64):

* chi-squared: how uneven the symbols are, against the unevenness that text of
  that length would show;
* runs: how often the character class changes, against text's rate;
* serial correlation: how far neighbouring symbols follow each other.

The three scores are added (each is standard normal for text) and judged by
Benjamini-Hochberg control within length classes over all tokens of the corpus.
Scores are counted in bins, so only a bounded table decides the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import erfc
from tidemark.llm.common import hidden_names, stage, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs of at least so many characters, as the shorter runs are dropped anyway.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
VALUE, RATE, STEP = 6, 0.01, 20
#: Rate of class changes between letters and digits in ordinary text, and the serial correlation of ordered text.
CHANGES, ORDERED = 0.1, 0.5
#: Encoding: pattern, alphabet, and how uneven text is in it (k * sum of squared shares - 1).
ENCODINGS = (
    ("[0-9]+", 10, 0.5),
    ("[0-9a-f]+|[0-9A-F]+", 16, 1.6),
    ("[a-z]+|[A-Z]+", 26, 0.8),
    ("[A-Z2-7]+", 32, 1.0),
    ("[a-z0-9]+|[A-Z0-9]+", 36, 1.4),
    (".*", 64, 3.2),
)


#: Items of an array that are folded at once, and characters that are looked at one by one at once.
PART, CHARACTERS = 256, 4096
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(size: Column, part: int) -> Column:
    """Where the parts of that many things begin."""
    return F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(part))


def _folded(items: Column, kind: str, step) -> Column:
    """(at, since, out) after ``step`` over all items; ``out`` is an array of ``kind``, ``at`` starts from 0 and ``since`` from -1.

    Items are folded part by part, so that appending copies a part and not all
    that came before: linear in the items but for a list of parts.
    """
    none = F.array().cast(f"array<{kind}>")

    def add(acc, some):
        folded = F.aggregate(some, F.struct(acc["at"].alias("at"), acc["since"].alias("since"), none.alias("out")), step)
        return _let(folded, lambda d: F.struct(d["at"].alias("at"), d["since"].alias("since"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("since"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    parts = F.transform(_parts(F.size(items), PART), lambda i: F.slice(items, i + 1, PART))
    return F.aggregate(parts, start, add, lambda acc: F.struct(acc["at"].alias("at"), acc["since"].alias("since"), F.flatten(acc["out"]).alias("out")))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, value), in code points."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def step(acc, m):
        begin = acc["at"] + F.char_length(m["0"])
        end = begin + F.char_length(m["1"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["2"].alias("value"))
        return F.struct(end.alias("at"), acc["since"].alias("since"), F.concat(acc["out"], F.array(span)).alias("out"))

    matches = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("0"), whole.alias("1"), value.alias("2"))
    found = _let(matches, lambda m: _folded(m, _SPAN, step)["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _chars(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit("."), F.lit(0))


def _symbols(v: Column) -> Column:
    """The distinct characters of a token; a long one is asked for each that tokens may hold."""
    alphabet = F.array(*[F.lit(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"])
    return F.when(F.char_length(v) > CHARACTERS, F.filter(alphabet, lambda a: v.contains(a))).otherwise(F.array_distinct(_chars(F.substring(v, 1, CHARACTERS))))


def _sums(v: Column) -> Column:
    """Sum s, sum of squares q and sum of neighbours' products c of a token's character codes; few characters are held at once."""
    zero = F.lit(0.0)

    def add(acc, i):
        codes = F.transform(_chars(F.substring(v, i + 1, F.lit(CHARACTERS + 1))), lambda x: F.ascii(x).cast("double"))  # and the next part's first
        own = lambda c: F.slice(c, 1, CHARACTERS)
        return _let(
            codes,
            lambda c: F.struct(
                F.aggregate(own(c), acc["s"], lambda a, x: a + x).alias("s"),
                F.aggregate(own(c), acc["q"], lambda a, x: a + x * x).alias("q"),
                F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * y), acc["c"], lambda a, x: a + x).alias("c"),
            ),
        )

    return F.aggregate(_parts(F.char_length(v), CHARACTERS), F.struct(zero.alias("s"), zero.alias("q"), zero.alias("c")), add)


def score(v: Column) -> Column:
    """How unlike text a token of ASCII characters is: standard normal for text, strongly negative for random."""
    k = F.lit(64)
    uneven = F.lit(3.2)
    for pattern, size, share in reversed(ENCODINGS):
        fits = v.rlike(f"^(?:{pattern})$")
        k, uneven = F.when(fits, F.lit(size)).otherwise(k), F.when(fits, F.lit(share)).otherwise(uneven)
    n = F.char_length(v).cast("double")
    squares = F.aggregate(_symbols(v), F.lit(0.0), lambda a, x: a + F.pow(n - F.char_length(F.replace(v, x, F.lit(""))), 2))
    chi = squares * k / n - n
    z_chi = (chi - (k - 1) - n * uneven) / F.sqrt(2 * (k - 1) + 4 * n * uneven)

    plain = F.regexp_replace(v, "[^A-Za-z0-9]", "")
    classes = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    steps = F.greatest(F.char_length(plain) - 1, F.lit(1)).cast("double")
    # A change is counted at each end of a run: runs - 1.
    runs = F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1
    z_runs = (CHANGES * steps - runs) / F.sqrt(steps * CHANGES * (1 - CHANGES))

    sums = _sums(v)
    mean = sums["s"] / n
    spread = sums["q"] - n * mean * mean
    cross = sums["c"] - n * mean * mean
    serial = F.when(spread > 1e-9, F.least(F.lit(1.0), F.abs(cross / spread))).otherwise(F.lit(1.0))
    z_serial = (serial - ORDERED) * F.sqrt(n)
    return (z_chi + z_runs + z_serial) / F.sqrt(F.lit(3.0))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (spans of the patterns) and ``_tokens`` (start, end, bin, class of tested tokens)."""
    text = text_or_empty(text)
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= VALUE)
    found = docs.withColumn("_base", F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    free = F.filter(_spans(text, TOKEN, 3), lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def judge(s):
        n = F.char_length(s["value"])
        z = F.floor(F.least(F.greatest(score(s["value"]), F.lit(-20.0)), F.lit(5.0)) * STEP).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), z.alias("bin"), F.when(n < 32, 0).when(n < 64, 1).otherwise(2).alias("class"))

    return found.withColumn("_tokens", F.transform(free, judge))


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """One row with ``_limits``: for each length class the largest bin that false-discovery control accepts."""
    counts = scanned.select(F.explode("_tokens").alias("k")).groupBy(F.col("k.class").alias("class"), F.col("k.bin").alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("class").orderBy("bin")
    whole = Window.partitionBy("class")
    p = 0.5 * erfc(-(F.col("bin") + 1) / F.lit(float(STEP)) / F.sqrt(F.lit(2.0)))  # normal
    ok = counts.withColumn("upto", F.sum("n").over(up)).withColumn("m", F.sum("n").over(whole)).where(p * F.col("m") <= rate * F.col("upto"))
    best = ok.groupBy("class").agg(F.max("bin").alias("limit"))
    return best.agg(F.map_from_entries(F.collect_list(F.struct("class", "limit"))).alias("_limits"))


def judged(scanned: DataFrame, limits: DataFrame) -> DataFrame:
    """``scanned`` with ``_spans``: base spans and accepted tokens by start, then kind."""
    df = scanned.crossJoin(F.broadcast(limits))  # one row
    accepted = F.filter("_tokens", lambda k: F.coalesce(k["bin"] <= F.try_element_at("_limits", k["class"]), F.lit(False)))
    random = F.transform(accepted, lambda k: F.struct(k["start"].alias("start"), F.lit(3).alias("kind"), k["end"].alias("end")))
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn("_base", F.sort_array(base)).withColumn("_spans", F.sort_array(F.concat(base, random))).drop("_tokens", "_limits")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"]))
    return F.array_join(one, ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_assign, n_access, n_hex, base_sha256, spans and n_random.

    Offsets are code points, ends exclusive. A null or empty text has no spans.
    Repeated rows and null doc_ids are scanned like any other; an empty table
    gives an empty one. A token that overlaps a base span is not tested.
    """
    scanned = stage(scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    df = judged(scanned, thresholds(scanned))

    def n(kind):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    return df.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined("_base"), 256).alias("base_sha256"),
        _joined("_spans").alias("spans"),
        n(3).alias("n_random"),
    )


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (text, ...) with every found span of the text replaced by ``mask``, overlapping ones by one; all columns stay, whatever their names.

    No row goes. A null text stays null; texts of any length are scanned whole,
    once, and a masked one is put together block by block. Repeated rows and
    null doc_ids are masked like any other; an empty table gives an empty one.
    """
    hidden, names = hidden_names(docs)
    own = f"_c{docs.columns.index('text')}"
    scanned = stage(scan(hidden, own))
    df = judged(scanned, thresholds(scanned)).withColumn("_gone", _united(F.col("_spans")))
    text = F.when(F.size("_gone") > 0, _masked(F.col(own), F.col("_gone"), mask)).otherwise(F.col(own))
    return df.withColumn(own, text).select(*names)


def _united(spans: Column) -> Column:
    """Spans by start -> their unions (start, end)."""
    kind = "struct<start:int,end:int>"

    def held(acc):
        return F.when(acc["since"] < 0, F.array().cast(f"array<{kind}>")).otherwise(F.array(F.struct(acc["since"].alias("start"), acc["at"].alias("end"))))

    def step(acc, s):
        new = (acc["since"] < 0) | (s["start"] >= acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, s["start"]).otherwise(acc["since"]).alias("since"), F.when(new, F.concat(acc["out"], held(acc))).otherwise(acc["out"]).alias("out")
        )

    return _let(_folded(spans, kind, step), lambda d: F.concat(d["out"], held(d)))


def _masked(text: Column, gone: Column, mask: str, block: int = 1 << 16) -> Column:
    """The text without the spans ``gone``, each block of it cut on its own, as a place in a long text is found by walking there."""

    def cut(piece, i):
        lo = i * block
        inside = F.filter(gone, lambda s: (s["start"] < lo + block) & (s["end"] > lo))

        def before(all_):
            def one(s, k):
                begin = F.when(k > 0, F.element_at(all_, F.greatest(k, F.lit(1)))["end"] - lo).otherwise(F.lit(0))  # the span before
                kept = F.substring(piece, begin + 1, F.greatest(s["start"] - lo - begin, F.lit(0)))
                return F.concat(kept, F.when(s["start"] >= lo, F.lit(mask)).otherwise(F.lit("")))

            rest = F.when(F.size(all_) > 0, F.substring(piece, F.element_at(all_, -1)["end"] - lo + 1, F.lit(block))).otherwise(piece)
            return F.concat(F.array_join(F.transform(all_, one), ""), rest)

        return _let(inside, before)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, cut), "")
