import random

import numpy as np
import pytest

from tidemark.llm.toxicity import drop_toxic, expected, fit_ordinal, severity


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "th er on re an le".split() for b in "a tion ing ed es un".split()]
    bad = ["vilest", "rotten", "grubalo", "grubane", "grubist"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 300))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.choice([2, 6, 15])):
                words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 600)
    x = (grade[:, None] + rng.normal(size=(600, 3)) * 0.5) @ np.diag([1.0, 0.5, 0.0])
    rows, cols = np.repeat(np.arange(600), 3), np.tile(np.arange(3), 600)
    w, b = fit_ordinal(rows, cols, x.ravel(), grade, 3, 4)
    assert np.all(np.diff(b) > 0)
    scores = expected(w, b, x @ w)[0]
    assert np.corrcoef(scores, grade)[0, 1] > 0.85
    assert scores.min() >= 0 and scores.max() <= 3


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    schema = "doc_id long, text string, severity string"
    df = spark.createDataFrame(docs + [(900, None, ""), (901, "", ""), (None, "vilest " * 9, ""), (3, docs[3][1], "again")], schema)
    known = spark.createDataFrame(labels[:200] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = severity(df, known).collect()
    assert len(got) == len(docs) + 4
    by = {r["doc_id"]: r for r in got}
    held = range(200, 400)
    assert sum(by[i]["toxic"] == (i % 5 == 0) for i in held) >= 196
    assert not any(by[i]["toxic"] for i in held if i % 5)
    assert by[None]["toxic"] and not by[900]["toxic"] and by[900]["severity"] == by[901]["severity"]
    kept = drop_toxic(df, known)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(400)) - set(ids) == {i for i in range(400) if by[i]["toxic"]} and ids.count(3) == 2


@pytest.mark.parametrize("labels", [[], [(1, 0, 1)], [(1, 1, 1)]])
def test_without_both_classes_nothing_is_rejected(spark, labels):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    assert [r["toxic"] for r in severity(docs, known).collect()] == [False, False]
    assert severity(docs.limit(0), known).count() == 0


def test_severity_follows_held_out_density(spark):
    rng = random.Random(5)
    docs, known, dense = [], [], []
    for i in range(400):
        words = [rng.choice(["stone", "river", "lamp", "cloud", "tree"]) for _ in range(100)]
        n = [0, 1, 4, 12][i % 4]
        for at in rng.sample(range(100), n):
            words[at] = rng.choice(["vilest", "rotten", "grubane"])
        docs.append((i, " ".join(words)))
        dense.append(n)
        if i < 200:
            known.append((i, int(n > 0)))
    got = severity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    by = {r["doc_id"]: r for r in got}
    mean = [np.mean([by[i]["severity"] for i in range(200, 400) if dense[i] == n]) for n in (0, 1, 4, 12)]
    assert all(np.diff(mean) > 0.3) and mean[0] < 0.3


def test_clashing_columns_and_long_text(spark):
    docs, labels = corpus(n=100)
    long_ok, long_bad = "stone river lamp " * 700_000, "stone vilest lamp " * 700_000  # over 10 MB each
    rows = [(d, t, d, t, 1.5, "f") for d, t, _ in docs] + [(-1, long_ok, 0, "x", 2.5, None), (-2, long_bad, 0, "x", 2.5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _c0 long, _text string, severity double, features string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    kept = drop_toxic(df, known)
    assert kept.columns == df.columns
    got = {r["doc_id"]: r for r in kept.select("doc_id", "_c0", "severity", (kept["text"] == kept["_text"]).alias("same")).collect()}
    assert -1 in got and -2 not in got and all(r["_c0"] == d and r["same"] and r["severity"] == 1.5 for d, r in got.items() if d >= 0)
