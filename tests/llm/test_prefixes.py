import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.prefixes import PrefixCounter, count_tokens, longest_within, prefix_counts, tokens_at

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def odd_texts():
    rng = random.Random(4)
    signs = ["a", "aa", "the", " the", "ing", "'", "'re", "'ll", "'s", " ", "  ", "\n", "\r\n", "\t", "-", "--", "=", "0", "12", "é", "ß", "中", "😀", "́", "\xa0", "\x85", "　", "\x1c", "​", "\x00", "<|endoftext|>", "<|", "|>", "<|endoftext", "X", ".", "!"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(250)]
    texts += ["".join(rng.choices("ab", k=90)), "a" * 150, " " * 70 + "x", "-" * 200, "\n" * 40 + " x", "abcabcabc" * 12, "we're we'l he'd 'twas", "<|endoftext|><|endoftext|> a", "  <|endoftext|>\n\n<|endoftext|>"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(30)) for _ in range(40)]
    return texts


def test_every_prefix_has_the_count_of_its_own_encoding(tokenizer):
    known = PrefixCounter(FILE)
    for text in odd_texts():
        want = [len(e.ids) for e in tokenizer.encode_batch([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False)]
        assert known.differences(text).cumsum().tolist() == want, repr(text)


def test_a_small_cache_changes_nothing(tokenizer):
    known = PrefixCounter(FILE, most=3)
    for text in odd_texts()[:40]:
        assert int(known.differences(text).sum()) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_of_documents(spark, tokenizer):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(0, 10**9)}," for _ in range(300_000))
    solid = "".join(rng.choices("abcdefg", k=200_000))
    texts = [None, "", " ", "one", "one two", long, solid, *odd_texts()[:30]]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(3, "one", "again", 7), (None, "one two", "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, block int")
    got = count_tokens(docs, FILE, 50).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in [*enumerate(texts), (None, "one two")]:
        r, n = by_id[i], len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 50)
        if t and len(t) < 500:
            fits = max(k for k in range(len(t) + 1) if len(tokenizer.encode(t[:k], add_special_tokens=False).ids) <= 50)
            assert r["fits_chars"] == fits
    assert count_tokens(docs.limit(0), FILE).count() == 0


def test_stored_counts_answer_questions(spark, tokenizer):
    texts = {i: t for i, t in enumerate(odd_texts()[:60])} | {60: None, 61: "word " * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stored = prefix_counts(docs, FILE, block=16).cache()
    asked = [(i, k) for i, t in texts.items() for k in range(0, len(t or "") + 2, 3)] + [(999, 1)]
    got = {(r["doc_id"], r["at"]): r["n_tokens"] for r in tokens_at(stored, spark.createDataFrame(asked, "doc_id long, at long"), 16).collect()}
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for (i, k), found in got.items():
        assert found == (n((texts[i] or "")[:k]) if k <= len(texts[i] or "") else None)
    assert {k for k in asked if k[0] < 999 and k[1] <= len(texts[k[0]] or "")} <= set(got)
    fits = {r["doc_id"]: r["chars"] for r in longest_within(stored, 6, 16).collect()}
    for i, t in texts.items():
        assert fits[i] == max(k for k in range(len(t or "") + 1) if n((t or "")[:k]) <= 6)
    stored.unpersist()
