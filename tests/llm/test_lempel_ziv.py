import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.lempel_ziv import SIZE, edited, fingerprints, signature


def plain(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return sorted({xxhash.xxh32_intdigest(p) for p in seen})[:SIZE]


def alike(a, b):
    union = sorted({*a, *b})[:SIZE]
    return len([h for h in union if h in a and h in b]) / len(union) if union else 1.0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_against_brute_force(spark, parts):
    rng = random.Random(8)
    words = ["the", "ünder", "🙂", "thing", "ation", "über\n", "a"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 200, 3000] if i % 10 == 0 else [0, 3, 60])))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x"), (203, rows[5][1]), (204, rows[5][1])]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, part string")
    got = {r["doc_id"]: r for r in fingerprints(df, parts).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert set(got) == {d for d, _ in rows}
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        r, e = got[d], edited(t, nxt)
        assert r["n_chars"] == len(t)
        assert e == t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in plain(t))
        assert r["edited_fingerprint"] == "".join(f"{h:08x}" for h in plain(e))
        assert abs(r["near_edited"] - alike(plain(t), plain(e))) < 1e-12
        assert abs(r["near_next"] - alike(plain(t), plain(nxt))) < 1e-12


def test_repeated_rows_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "ab ab"), (1, "ab ab"), (None, "q"), (None, None)], schema)
    got = fingerprints(df, 4).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None", "None"]
    assert 1.0 in [r["near_next"] for r in got if r["doc_id"] == 1]
    one = fingerprints(spark.createDataFrame([(5, "abcabc")], schema), 4).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and signature("abcabc").size
    assert fingerprints(spark.createDataFrame([], schema), 4).count() == 0


def test_hot_id_is_split_and_long_text(spark):
    rows = [(7, f"text {i} of one id") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(1, "abc déf 🙂 " * 1_000_000)]  # 14 MB
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints(df, 8).select("*", F.spark_partition_id().alias("at")).collect()
    assert len(found) == len(rows) and max(Counter(r["at"] for r in found).values()) < 200
    long = [r for r in found if r["doc_id"] == 1]
    assert [r["n_chars"] for r in long] == [len(rows[-1][1])] and long[0]["fingerprint"] == "".join(f"{h:08x}" for h in plain(rows[-1][1]))
    assert {r["fingerprint"] for r in found} == {"".join(f"{h:08x}" for h in signature(t)) for _, t in rows}
