import random

import numpy as np

from tidemark.llm.mixing import DOMAINS, domain_labels, fit_rates, mixing_rates, repeat_to_targets


def corpus(n=300):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        low = i % 3 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + ("&&&" if low else "") for _ in range(rng.randint(5, 80))]
        if i % 10 == 9:
            words += ["awful", "horrid"] * 3
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 0 if low else 1, int(i % 10 == 9)))
    return docs, labels


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], size=400)
    t = rng.integers(0, 1000, 400)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens long, p array<double>")
    total = float(t.sum())
    for share in ([0.5, 0.3, 0.2], [0.2, 0.35, 0.45]):
        got = fit_rates(df, [s * total for s in share]).collect()
        r = np.array([x["rate"] for x in got])
        reached = (np.array([x["tokens"] for x in got]) * r) @ np.array([x["p"] for x in got]) / total
        assert r.min() >= 0 and np.abs(reached - share).max() < 2e-3


def test_rates_of_skewed_domains(spark):
    rng = np.random.default_rng(4)
    for share in ([0.98, 0.018, 0.002], [0.1, 0.899, 0.001]):
        p = np.full((4000, 3), 0.015)
        p[np.arange(4000), rng.choice(3, 4000, p=share)] = 0.97
        df = spark.createDataFrame([(100, x.tolist()) for x in p], "tokens long, p array<double>")
        fitted = fit_rates(df, [s * 400_000 for s in (0.10, 0.88, 0.02)])
        r = np.array([x["rate"] for x in fitted.collect()])
        reached = r @ p / 4000
        assert r.min() >= 0 and np.abs(reached - [0.10, 0.88, 0.02]).max() < 2e-4
        assert np.allclose(np.array(fitted.reached) / 400_000, reached, atol=1e-6)


def test_reached_belongs_to_the_rates_when_steps_run_out(spark):
    p = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]
    df = spark.createDataFrame([(1000 * (i + 1), x) for i, x in enumerate(p)], "tokens long, p array<double>")
    for steps in (1, 2):
        fitted = fit_rates(df, [1000.0, 3000.0, 2000.0], steps=steps)
        rows = fitted.collect()
        true = sum(x["tokens"] * x["rate"] * np.array(x["p"]) for x in rows)
        assert np.allclose(fitted.reached, true)


def test_targets_out_of_reach_are_told(spark, caplog):
    df = spark.createDataFrame([(100, [0.6, 0.4, 0.0])] * 50, "tokens long, p array<double>")
    fitted = fit_rates(df, [0.0, 5000.0, 0.0])
    assert "out of reach" in caplog.text and abs(fitted.reached[0] - fitted.reached[1] * 1.5) < 1


def test_mixing(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + [(900, None, "x"), (901, "", "x"), (None, "alpha beta", "x"), (3, docs[3][1], "x")], "doc_id long, text string, rate string")
    known = spark.createDataFrame(labels[:150] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = mixing_rates(df, known, {"low": 0.2, "high": 0.6, "toxic": 0.2}).collect()
    assert len(got) == len(docs) + 4
    right = 0
    for r in got:
        p = [r[f"p_{d}"] for d in DOMAINS]
        assert abs(sum(p) - 1) < 1e-9 and r["rate"] >= 0
        if r["doc_id"] is not None and 150 <= r["doc_id"] < 300:
            i = r["doc_id"]
            right += DOMAINS[int(np.argmax(p))] == ("toxic" if i % 10 == 9 else "low" if i % 3 == 0 else "high")
    assert right >= 143
    total = sum(r["tokens"] for r in got)
    for d, share in (("low", 0.2), ("high", 0.6), ("toxic", 0.2)):
        assert abs(sum(r["tokens"] * r["rate"] * r[f"p_{d}"] for r in got) / total - share) < 0.01
    out = repeat_to_targets(df, known, {"low": 0.2, "high": 0.6, "toxic": 0.2})
    assert out.columns == df.columns
    for d, share, n in zip(DOMAINS, (0.2, 0.6, 0.2), out.reached):
        assert abs(n / sum(out.reached) - share) < 1e-3
    rows = out.collect()
    # The rows written hold these shares too, but for the rounding of rates.
    p = {r["doc_id"]: (r["tokens"], [r[f"p_{d}"] for d in DOMAINS]) for r in got}
    have = sum(p[r["doc_id"]][0] * np.array(p[r["doc_id"]][1]) for r in rows)
    assert np.abs(have / have.sum() - [0.2, 0.6, 0.2]).max() < 0.03
    assert {r["rate"] for r in rows} == {"x"}
    assert {(r["doc_id"], r["text"]) for r in rows} == {(d, t) for d, t, *_ in docs} | {(900, None), (901, ""), (None, "alpha beta")}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert domain_labels(known).count() == 0
    assert mixing_rates(docs, known).count() == 0 and repeat_to_targets(docs, known).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert mixing_rates(some, known).collect()[0]["p_low"] == 1 / 3


def test_clashing_columns_and_long_text(spark):
    docs, labels = corpus(60)
    long = "alpha beta " * 1_000_000  # 11 MB
    df = spark.createDataFrame([(i, t, "r", i, "p", t) for i, t, _ in docs] + [(700, long, "r", 700, "p", "")], "doc_id long, text string, rate string, tokens long, p string, _text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = repeat_to_targets(df, known)
    assert out.columns == df.columns
    got = out.selectExpr("doc_id", "rate", "tokens", "p", "length(text) as n", "length(_text) as m").distinct().collect()
    assert {tuple(r) for r in got} == {(i, "r", i, "p", len(t), len(t)) for i, t, _ in docs} | {(700, "r", 700, "p", len(long), 0)}
    assert [r["tokens"] for r in mixing_rates(df, known).where("doc_id = 700").collect()] == [2_000_000]
