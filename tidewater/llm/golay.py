"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

Every 23-bit word is within 3 bits of exactly one codeword. Taking all codewords within 4 bits of a word gives
1 key (if the nearest is within 2 bits: 277 of 2048 words) or 6 keys (otherwise), and two words that differ in at
most 2 bits always share a key: take the word halfway between them; its nearest codeword is within 3 bits of it and
so within 4 bits of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code (fixed value).
GENERATOR = 0b101011100011
MOST_KEYS = 6


def _syndrome(x: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and for each syndrome what to flip for each near codeword (-1: none)."""
    of_bit = [_syndrome(1 << i) for i in range(BITS)]
    by_byte = np.zeros((3, 256), np.int64)
    for b in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * b + i < BITS:
                    by_byte[b, v] ^= of_bit[8 * b + i]
    flips: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            s = 0
            for i in at:
                s ^= of_bit[i]
            if weight < 4 or flips[s] and bin(flips[s][0]).count("1") == 3:
                flips[s].append(sum(1 << i for i in at))
    out = np.full((2048, MOST_KEYS), -1, np.int64)
    for s, own in enumerate(flips):
        out[s, : len(own)] = own
    return by_byte, out


_BY_BYTE, _FLIPS = _tables()


def near_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words, the 12-bit indices of their near codewords: (n, 6), -1 where a word has one only."""
    words = words.astype(np.int64)
    s = _BY_BYTE[0][words & 255] ^ _BY_BYTE[1][words >> 8 & 255] ^ _BY_BYTE[2][words >> 16]
    flips = _FLIPS[s]
    return np.where(flips < 0, -1, (words[:, None] ^ flips) >> 11)
