import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.common import stage

BAD = ["vilest", "rotten", "grubalo", "grubane"]
ASSIGN = re.compile(r"""((?i:password|secret))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")


def rows():
    rng = random.Random(12)
    plain = [f"{a}{b}" for a in "th er on re an le".split() for b in "a tion ing ed es un".split()]
    docs, labels = [], []
    for i in range(240):
        words = rng.choices(plain, k=rng.randint(30, 200))
        toxic, low = i % 8 == 0, i % 5 == 1
        if toxic:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if low:
            words = [w + "&&&" for w in words]
        if i % 11 == 3:
            words.insert(5, "password=hunter2secret")
        docs.append([i, " ".join(words), "en", f"src{i % 3}", 0])
        labels.append((i, 0 if low else 1, int(toxic)))
    docs += [[300 + i, docs[2 * i + 1][1], "en", "copy", 0] for i in range(20)]
    docs += [[400, None, "en", "s", 0], [401, "", None, None, None]]
    return docs, labels


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def lowest(docs):
    low = {d: d for d in docs}
    fps = {d: fingerprint(t) for d, t in docs.items()}
    for _ in range(4):
        for a in docs:
            low[a] = min(low[b] for b in docs if (fps[a] ^ fps[b]).bit_count() <= 2)
    return {d for d in docs if low[d] == d}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = rows()
    spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = [spark.read.parquet(f"{d}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], d)))
    return d, out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_against_brute_force(spark, stages):
    d, (docs, clean, single, masked, mixed, packed) = stages
    assert all(x.columns == docs.columns for x in (clean, single, masked, mixed))
    before = texts(docs)
    assert set(texts(clean)) == {i for i, t in before.items() if not any(b in (t or "") for b in BAD)}
    assert set(texts(single)) == lowest(texts(clean))
    assert texts(masked) == {i: None if t is None else ASSIGN.sub("[SECRET]", t) for i, t in texts(single).items()}
    repeats = Counter(r["doc_id"] for r in mixed.collect())
    assert texts(mixed) == texts(masked) and max(repeats.values()) > 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts(mixed).items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(i, k // 2048, len(part), zlib.crc32(part.tobytes()))] += repeats[i]
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_run_is_the_stages(spark, stages):
    d, out = stages
    key = ["doc_id", "piece", "length", "ids_crc32"]
    a = Counter(tuple(r) for r in corpus_pipeline.run(spark, d).select(key).collect())
    assert a == Counter(tuple(r) for r in out[-1].select(key).collect())
