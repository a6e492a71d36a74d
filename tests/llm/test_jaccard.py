import random

import pytest

import corpus_pipeline
from tidemark.llm import jaccard
from tidemark.llm.jaccard import similar_components
from tidemark.llm.simhash import fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def lowest(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {a: [b for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in sets}
    low, was = {i: i for i in sets}, None
    while low != was:
        was, low = low, {a: min(low[b] for b in near[a]) for a in near}
    return low


def corpus():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(500)]
    texts = {0: None, 1: " \n", 2: "One two", 3: "one TWO"}
    for i in range(4, 24):
        texts[i] = " ".join(rng.choices(vocabulary, k=rng.randint(120, 300)))
    for i in range(24, 184):  # copies with changed words, on both sides of the rule, and chains of them
        w = texts[rng.randrange(4, i)].split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    return texts


@pytest.mark.parametrize("centres,block", [(4, 64), (1, 3)])
def test_components_of_all_similar_pairs(spark, centres, block):
    texts = corpus()
    df = spark.createDataFrame([*texts.items(), (9, texts[9]), (None, texts[10])], "doc_id long, text string")
    got = similar_components(df, centres, block).collect()
    want = lowest(texts)
    assert len(got) == len(texts) + 2 and len(set(want.values())) < 100
    for r in got:
        assert r["component_id"] == want[10 if r["doc_id"] is None else r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_many_texts_of_one_bucket(spark):
    rng = random.Random(8)
    passage = " ".join(f"shared{i}" for i in range(400))
    texts = {i: passage + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(130 + i % 40)) for i in range(300)}
    texts |= {1000 + i: texts[i] + " and more" for i in range(0, 300, 7)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = lowest(texts)
    got = {r["doc_id"]: r["component_id"] for r in similar_components(df).collect()}
    assert got == want and len(set(want.values())) == 300


def test_pipeline_stage_drops_near_copies(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, df, None)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(lowest(texts).values()))


def test_golay_keys_link_without_bands(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(0, 200, 2):
        w = [f"word{rng.randrange(500)}" for _ in range(rng.randint(150, 400))]
        texts[i], texts[i + 1] = " ".join(w), " ".join(w[: -1 - i % 3])  # a word or a few less
    line = " ".join(f"often{i}" for i in range(12))
    texts |= {1000 + i: " ".join([line] * 300 + [f"tail{i}x{j}" for j in range(40)]) for i in range(6)}  # near in bits, not in sets
    texts |= {2000: "Two \n words", 2001: "two words"}
    bits = {i: fingerprint(t.encode(), 5) for i, t in texts.items()}
    close = {(a, b) for a in texts for b in texts if a > b and (bits[a] ^ bits[b]).bit_count() <= 2}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {(a, b) for a, b in close if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in bits.items()}
    classes = spark.createDataFrame([(i, signed[i], [i]) for i in texts], "t long, fp long, bands array<long>")  # no band is shared
    got = jaccard.links(classes, spark.createDataFrame(list(texts.items()), "t long, text string")).collect()
    assert {(r["u"], r["v"]) for r in got} == want and len(want) > 10 and len(close) > len(want)


def test_empty(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
