import hashlib
import random
from collections import Counter

from tidemark.llm.substring import WINDOW, remove_repeats


def brute(rows):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(500)]

    def prose(n):
        return rng.choices(words, k=n)

    passages = [prose(n) for n in (34, 35, 36, 40, 55, 90)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "x " * 200), (5, " ".join(prose(50)))]
    for i in range(6, 60):
        body = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(body)))
    rows += [(60, rows[20][1]), (60, rows[20][1]), (61, rows[21][1]), (None, rows[22][1]), (None, " ".join(prose(80))), (62, "short copy"), (63, "short copy")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, n_words string, t int")
    got = [tuple(r) for r in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts(spark):
    one = " ".join(f"w{i}" for i in range(1_300_000))  # 10 MB
    rows = [(1, one), (2, "x " + " ".join(f"w{i}" for i in range(700_000, 700_040)) + " y"), (3, "short")]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r["n_words"], r["n_removed"]) for d, r in got.items()} == {1: (1_300_000, 40), 2: (42, 40), 3: (1, 0)}
    words = one.split()
    assert got[1]["kept_sha256"] == hashlib.sha256(" ".join(words[:700_000] + words[700_040:]).encode()).hexdigest()
