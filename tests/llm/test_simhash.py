import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm import jaccard
from tidemark.llm.simhash import keep_first, links, simhash_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps):
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return dict(zip(ids, low))


def test_codewords_are_shared_within_two_bits():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(23)
        b = a
        for at in rng.sample(range(23), rng.randint(0, 2)):
            b ^= 1 << at
        codes, n = golay.codeword_keys(np.array([a, b]))
        assert set(codes[0][: n[0]]) & set(codes[1][: n[1]])


def test_links_give_the_components_of_all_close_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    words = set(base)
    for b in base:
        for _ in range(60):
            w = b
            for at in rng.sample(range(64), rng.randint(1, 4)):
                w ^= 1 << at
            words.add(w)
    words = sorted(w - (1 << 64) if w >> 63 else w for w in words)
    from tidemark.llm.graph import components

    want = brute(words, [w & (1 << 64) - 1 for w in words])
    for bucket in (1, 32):  # one forces the one-bit balls
        df = spark.createDataFrame([(w,) for w in words], "fp long")
        got = {r["id"]: r["component"] for r in components(links(df, bucket)).collect()}
        assert {w: got.get(w, w) for w in words} == want


def test_components_of_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"Wort{i}" for i in range(300)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one", 5: "a b", 6: "é  Ü x"}
    for i in range(7, 40):
        texts[i] = " ".join(rng.choices(vocabulary, k=400))
    for i in range(40, 80):
        w = texts[7 + i % 8].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    rows = [(i, t, "x") for i, t in texts.items()] + [(9, texts[9], "again"), (None, texts[10], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash_components(df).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = brute(list(texts), list(fps.values()))
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        else:
            assert r["component_id"] == want[10]
    kept = keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None not in ids and sorted(ids) == sorted(set(want.values()))  # the row without an id is a copy of row 10


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).where(F.lit(True)).count() == 0


def test_keep_first_judges_texts_not_ids(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(3))
    long = " ".join(f"q{i}" for i in range(1_500_000))  # 11 MB
    rows = [(1, a, 1, "x"), (1, b, 2, "x"), (None, c, 3, "x"), (None, c, 4, "x"), (None, c, 5, "x"), (None, a, 6, "x"), (4, b, 7, "x"), (9, None, 8, "x"), (8, "", 9, "x"), (5, long, 10, "x"), (6, long, 11, "x")]
    for keep in (keep_first, lambda d: keep_first(d, jaccard.text_classes)):
        df = spark.createDataFrame(rows, "doc_id long, text string, h int, root string")
        got = keep(df)
        assert got.columns == df.columns
        found = sorted((str(r["doc_id"]), (r["text"] or "")[:50]) for r in got.collect())
        assert found == sorted([("1", a[:50]), ("1", b[:50]), ("None", c[:50]), ("8", ""), ("5", long[:50])])
        assert keep(df.limit(0)).count() == 0
