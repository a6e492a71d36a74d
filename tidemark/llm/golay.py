"""The perfect binary Golay code of 23 bits: decoding to codeword indices."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the code's generator polynomial, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
BITS = 23


def _remainder(word: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; for each of the 2,048 remainders, the six
    error patterns of weight up to 4 to its codewords; and how many of them count.

    Every word is within 3 bits of exactly one codeword. A word 1 or 2 bits from
    it has no other codeword within 4 bits, a word 3 bits from it has exactly
    five. Two words at most 2 bits apart therefore share a codeword within 4
    bits: the one that decodes a word between them.
    """
    upper = np.array([_remainder(h << 11) for h in range(1 << 12)], dtype=np.int64)
    heavy = [w for m in range(1 << 12) if (w := (m << 11) | int(upper[m])).bit_count() == 7]
    errors, counts = np.zeros((1 << 11, 6), dtype=np.int64), np.ones(1 << 11, dtype=np.int64)
    for weight in range(4):
        for at in combinations(range(BITS), weight):
            e = sum(1 << i for i in at)
            r = _remainder(e)
            errors[r, 0] = e
            if weight == 3:
                errors[r, 1:] = [w ^ e for w in heavy if w & e == e]
                counts[r] = 6
    return upper, errors, counts


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """23-bit words -> (n, 6) codeword indices of 12 bits, and how many of each row count (1 or 6)."""
    upper, errors, counts = tables()
    words = words.astype(np.int64)
    r = upper[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ errors[r]) >> 11, counts[r]
