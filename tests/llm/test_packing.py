import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import TOKENIZER, Encoder, pack, pack_documents, pieces, sequences

FILE = public_tokenizers.path(TOKENIZER)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Sequential best fit by falling length, for comparison: matches (length, first rank, pieces, first sequence, offset) of piece runs.

    ``counts`` has the number of pieces of each length from 1 to ``capacity``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_sizes, matches, opened = 0, [], 0

    def put(gap: int, first: int, n: int) -> None:
        nonlocal open_sizes
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))
            open_sizes |= 1 << gap

    for size in sorted(counts, reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            fits = open_sizes >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    open_sizes ^= 1 << gap
                take = min(m, n - rank)
                matches.append((size, rank, take, first, capacity - gap))
                put(gap, first + take, m - take)
                put(gap - size, first, take)
                rank += take
            else:
                left, per = n - rank, capacity // size
                new = -(-left // per)
                each, more = divmod(left, new)
                for j in range(each + (more > 0)):
                    take = new if j < each else more
                    matches.append((size, rank, take, opened, j * size))
                    rank += take
                put(capacity - (each + 1) * size, opened, more)
                put(capacity - each * size, opened + more, new - more)
                opened += new
    return matches


def text(rng, n):
    words = ["Hello", "it's", "WORLD's", "don't", "naïve", "Straße", "ÉCOLE", "x1y22", "½", "日本語", "áb", "<|endoftext|>", "!!", "e.g.,", "İstanbul", "ς", "🙂🙂", "they'll've", "a b", "foo_bar", " ", "\x1cq"]
    return "".join(rng.choice(words) + str(rng.choice(["", rng.randint(0, 99)])) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(n))


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    t, e = Tokenizer.from_file(FILE), Encoder(FILE, most=50)
    for _ in range(60):
        texts = [text(rng, rng.randint(0, 40)) for _ in range(5)]
        for got, s in zip(e.encode([x.encode() for x in texts]), texts):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_sweep_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 16, 64])
    counts = {s: rng.randint(1, 40) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    place, placed = defaultdict(list), defaultdict(set)
    for size, lo, m, first, offset in sweep(counts, capacity):
        for i in range(m):
            place[first + i].append((offset, size))
            placed[size].add(lo + i)
    assert all(placed[s] == set(range(n)) for s, n in counts.items())
    assert sorted(place) == list(range(len(place)))
    for got in place.values():
        at = 0
        for offset, size in sorted(got):
            assert offset == at
            at += size
        assert at <= capacity
    # No worse than sequential best fit over falling lengths.
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    assert len(place) <= len(gaps)


def test_documents(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n"), (None, "no id"), (3, "again"), (3, "again")] + [(i, text(rng, rng.randint(1, 300))) for i in range(4, 60)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    t = Tokenizer.from_file(FILE)
    want = []
    for d, s in rows:
        ids = t.encode(s or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 100):
            part = ids[i : i + 100]
            want.append((str(d), i // 100, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = pack_documents(df, FILE, 100).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 100 and len(at) <= 1.1 * sum(at.values()) / 100 + 2
    out = sequences(pack(pieces(df, FILE, 100, with_ids=True), 100)).collect()
    assert sum(len(r["ids"]) for r in out) == 4 * sum(at.values()) and max(len(r["ids"]) for r in out) <= 400


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


SHAPES = {
    "mixed": lambda rng: [rng.choice([rng.randint(1, 30), rng.randint(1, 300), rng.randint(300, 2048)]) for _ in range(6000)],
    "half": lambda rng: [rng.randint(900, 1150) for _ in range(2000)],
    "alike": lambda rng: [600] * 1000,
    "ones and long": lambda rng: [1] * 3000 + [rng.randint(1000, 2048) for _ in range(1500)],
    "short": lambda rng: [rng.randint(1, 9) for _ in range(3000)],
    "one": lambda rng: [5],
    "full": lambda rng: [2048] * 7,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_supersteps_against_sequential_best_fit(spark, shape):
    lengths = SHAPES[shape](random.Random(4))
    df = spark.createDataFrame([(None if i % 50 == 0 else i // 3, i, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = pack(df).collect()
    assert sorted((r["piece"], r["length"]) for r in got) == list(enumerate(lengths))
    place = defaultdict(list)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(place) == list(range(len(place)))
    for rows in place.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    best = max(first + m for _, _, m, first, _ in sweep(Counter(lengths), 2048))
    assert len(place) <= 1.001 * best + 2


def test_long_text(spark):
    long = "word and other " * 800_000  # 12 MB
    df = spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")
    got = pack_documents(df, FILE).where("doc_id = 1").collect()
    assert sum(r["length"] for r in got) == 2_400_001 and sorted(r["piece"] for r in got) == list(range(len(got)))
