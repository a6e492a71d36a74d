import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm.variants import near, spelling_variants


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if one_edit(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(close), form[w], words.get(form[w])]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def some_rows():
    rng = random.Random(8)
    base = ["colour", "behaviour", "straße", "éclair", "ÉCLAIR", "banana", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "bacde", "organise", "x×y÷zw", "ABCDEFGH"]
    signs = "abcdeéÉß×ÿ"
    words = list(base)
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(signs), rng.choice(signs) * 2])
            words.append("".join(w))
    rows = []
    for i in range(60):
        picked = rng.choices(words, weights=[1 + (k % 9) ** 3 for k in range(len(words))], k=80)
        rows.append((i, rng.choice([" ", ", ", "1", "\n", "Ā"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked)))
    return [*rows, (60, None), (61, ""), (3, rows[3][1]), (None, rows[5][1]), (62, " ".join("abcde"[i % 5 :] + "abcde"[: i % 5] for i in range(500)))]


@pytest.mark.parametrize("node", [8192, 40, 2])  # one node, a cut trie, whole paths told apart by halves
def test_words_against_brute_force(spark, node):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling_variants(docs, node=node).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in got} == want
    assert any(v[2] and v[4] != v[2] for v in want.values())


def test_near_is_one_edit():
    rng = random.Random(9)
    for _ in range(5000):
        a = "".join(rng.choices("ab", k=rng.randint(1, 6)))
        b = "".join(rng.choices("ab", k=rng.randint(len(a), len(a) + 2)))
        assert near(a, b) == one_edit(a, b)


def test_long_words_and_empty_table(spark):
    long = "ab" * 50_000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, f"{long} {long}x"), (3, f"{long} " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["n"], r["form"], r["root"]) for r in spelling_variants(docs).collect()}
    want = {w: (v[0], v[2], v[4]) for w, v in brute(rows).items()}
    assert got == want
    assert spelling_variants(docs.limit(0)).count() == 0
