import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.common import row_tie, stage
from tidemark.llm.hilbert import curve, hilbert_shards, range_ranks


def test_neighbours_on_the_curve_are_neighbours_in_space(spark):
    for dims, bits in ((2, 4), (3, 3)):
        cells = [r["cell"] for r in curve(spark, dims, bits).orderBy("h").collect()]
        points = [[c >> bits * i & (1 << bits) - 1 for i in range(dims)] for c in cells]
        assert len(set(cells)) == 1 << dims * bits
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é" * rng.randint(1, 500), "a b"]), rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src20", "", None]), "x") for i in range(500)]
    rows += [(7, "again", "en", "src1", "y"), (7, "again", "en", "src1", "y"), (None, "none", "fr", "ä", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    got = hilbert_shards(df).collect()
    want = Counter((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s])) for s in n)
    by = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in by] == sorted(r["hilbert"] for r in by)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_few_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert hilbert_shards(spark.createDataFrame([], schema)).count() == 0
    assert [r["slot"] for r in hilbert_shards(spark.createDataFrame([(1, None, None, None), (2, "a", "b", "c")], schema)).collect()] == [0, 0]


def test_cells_against_brute_force(spark):
    rng = random.Random(7)
    sources = [f"https://www.example.org/section_{i:03d}" for i in range(60)]  # one long common start
    rows = [(i, "x" * rng.choice([1, 5, rng.randint(0, 900)]), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(sources[:1] * 30 + sources + [None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bits = 3

    def cells(values):
        n, known, before, out = Counter(v for v in values if v is not None), sum(v is not None for v in values), 0, {None: 0}
        for v in sorted(n, key=lambda v: v.encode() if isinstance(v, str) else v):
            out[v] = before * (1 << bits) // known
            before += n[v]
        return [out[v] for v in values]

    dims = [cells([r[2] for r in rows]), cells([r[3] for r in rows]), cells([len(r[1]) for r in rows])]
    index = {r["cell"]: r["h"] for r in curve(spark, 3, bits).collect()}
    want = {r[0]: index[a << 2 * bits | b << bits | c] for r, a, b, c in zip(rows, *dims)}
    got = hilbert_shards(df, bits=bits).collect()
    assert {r["doc_id"]: r["hilbert"] for r in got} == want
    place = {r["doc_id"]: r["shard"] for r in got}
    order = sorted(want, key=lambda d: (want[d], d))
    assert [place[d] for d in order] == [k * 24 // len(rows) for k in range(len(rows))]

    # Files of shards are skipped more often than files of equal size in doc_id order.
    def read(shard_of):
        ranges = {}
        for (d, t, lang, source), s in ((r, shard_of(r[0])) for r in rows):
            ranges.setdefault(s, []).append((lang or "", source or "", len(t)))
        hit = 0
        for lo, hi in ((0, 50), (400, 450), (800, 900)):
            hit += sum(min(v[2] for v in x) <= hi and max(v[2] for v in x) >= lo for x in ranges.values())
        for source in sources[::10]:
            hit += sum(min(v[1] for v in x) <= source <= max(v[1] for v in x) for x in ranges.values())
        for lang in ("de", "fr"):
            hit += sum(min(v[0] for v in x) <= lang <= max(v[0] for v in x) for x in ranges.values())
        return hit

    assert read(place.get) < 0.75 * read(lambda d: d * 24 // len(rows))


def test_rows_without_an_id_are_spread_over_ranges(spark):
    docs = spark.range(12_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    base = stage(docs)
    tied = base.withColumn("tie", row_tie())
    sizes = [r["count"] for r in tied.repartitionByRange(8, "doc_id", "tie").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3500
    ranked = range_ranks(tied.withColumn("_n", F.lit(1).cast("long")), "doc_id", "tie")
    assert sorted(r["_before"] for r in ranked.collect()) == list(range(12_000))
    got = hilbert_shards(docs).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert [(r["n"], r["s"], r["m"]) for r in got] == [(500, 500, 499)] * 24


def test_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 6_000_000, "en", "a"), (2, "b", "en", "a")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in hilbert_shards(df).collect()}
    assert got[1]["size"] == 12_000_008 and got[1]["text_crc32"] == zlib.crc32(("é" * 6_000_000).encode())
