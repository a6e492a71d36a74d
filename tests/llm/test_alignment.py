import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm.alignment import Aligner, align_tokenizers
from tidemark.llm.prefixes import byte_signs

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    a_tokens, b_tokens, signs = Tokenizer.from_file(LEFT), SentencePieceProcessor(model_file=RIGHT), byte_signs()
    a_tokens.encode_special_tokens = True
    seen, made = Counter(), []
    for t in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        made.append(row)
        if not t:
            continue
        a = a_tokens.encode(" " + t, add_special_tokens=False).ids
        b = b_tokens.encode(t)
        spell_a = [bytes(ord(signs[c]) for c in a_tokens.id_to_token(i)) for i in a]
        spell_b = [bytes([int(b_tokens.id_to_piece(i)[3:5], 16)]) if b_tokens.is_byte(i) else b_tokens.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spell_a) != (" " + t).encode() or b"".join(spell_b) != (" " + t).encode():
            continue
        spans = lambda s: [(sum(map(len, s[:i])), sum(map(len, s[: i + 1]))) for i in range(len(s))]
        sa, sb = spans(spell_a), spans(spell_b)
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        low = 0
        for c in cuts:
            inside = lambda ids, s: ",".join(str(i) for i, (x, y) in zip(ids, s) if low <= x and y <= c)  # noqa: B023, E731
            row["groups"].append(inside(a, sa) + "|" + inside(b, sb))
            low = c
        row["a"], row["b"] = a, b
        row["links"] = [(i, j) for i, (x, y) in zip(a, sa) for j, (u, v) in zip(b, sb) if x < v and u < y]
        seen.update(set(row["links"]))
    top = defaultdict(int)
    for (a, _), n in seen.items():
        top[a] = max(top[a], n)
    return [
        (len(r["a"]), len(r["b"]), len(r["groups"]), len(r["links"]), sum(seen[p] == top[p[0]] for p in r["links"]), sum(seen[p] for p in r["links"]), hashlib.sha256(";".join(r["groups"]).encode()).hexdigest() if r["a"] else "", ";".join(r["groups"]))
        for r in made
    ]


def some_texts():
    rng = random.Random(6)
    signs = ["a", "the", " the", "ing", "tion", "'re", " ", " ", " ", "  ", "\n", "\r\n", "\t", "-", "==", "0", "12", "é", "ß", "中", "中文", "😀", "́", "\xa0", "\x85", "　", "\x1c", "\x00", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "X", "."]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(150)]
    texts += [None, "", " ", "   ", "one", "one", "a▁b is changed", "▁", "word " * 30, "\n", " \n ", "x" * 300, "internationalisation of tokenizers", "ſtraße naïve"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(20)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_documents_against_brute_force(spark, size):
    texts = some_texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, block long").repartition(3)
    got = align_tokenizers(docs, LEFT, RIGHT, with_groups=True, size=size).collect()
    want = brute(texts)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    rows = Counter((r["doc_id"], *[r[c] for c in names]) for r in got)
    assert rows == Counter((i if i % 9 else None, *w) for i, w in enumerate(want))


def test_small_memories_change_nothing():
    texts = some_texts()
    one, two = Aligner(LEFT, RIGHT), Aligner(LEFT, RIGHT, most=5)
    for lo in range(0, len(texts), 20):
        a, b = one.block(texts[lo : lo + 20]), two.block(texts[lo : lo + 20])
        assert [x.tolist() for x in a[0]] == [x.tolist() for x in b[0]]
        assert [a[3][c] for c in a[2]] == [b[3][c] for c in b[2]]


def test_long_text_and_empty_table(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randint(0, 10**6)}," for _ in range(200_000))
    solid = "".join(rng.choices("abcdefg", k=100_000))
    docs = spark.createDataFrame([(1, long), (2, solid), (3, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align_tokenizers(docs, LEFT, RIGHT).collect()}
    a, b = Tokenizer.from_file(LEFT), SentencePieceProcessor(model_file=RIGHT)
    for i, t in ((1, long), (2, solid)):
        assert (got[i]["n_a"], got[i]["n_b"]) == (len(a.encode(" " + t, add_special_tokens=False).ids), len(b.encode(t)))
    assert got[1]["groups_sha256"] == got[3]["groups_sha256"] != ""
    assert align_tokenizers(docs.limit(0), LEFT, RIGHT).count() == 0


def test_units_are_encoded_without_offsets_in_short_strings():
    known, sent = Aligner(LEFT, RIGHT), []
    plain, units = known.left, [f" unit{i}x{i * i}" for i in range(3000)] + [" <|endoftext|>", " naïve\n", " 中文"]

    class Recorded:
        def encode_batch_fast(self, strings, **options):
            sent.extend(strings)
            return plain.encode_batch_fast(strings, **options)

    known.left = Recorded()
    known.learn(units)
    assert "".join(sent) == "".join(units) and max(len(s.encode()) for s in sent) < 4096 + 64
    for u in units:
        left, right = plain.encode(u, add_special_tokens=False).ids, known.right.encode(u[1:])
        assert known.ids[u] == b"".join(i.to_bytes(4, "little") for i in [*left, *((1 << 31) + i for i in right)])
