"""The binary Golay code of 23 bits and 4,096 codewords, for fuzzy keys.

Every word is within three errors of exactly one codeword. A word's keys are the codewords
within four errors: one, or six if the nearest is three away. Two words that differ in at
most two bits share a key: some word between them is within one bit of both, and its
codeword is within three bits of it, so within four of both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial.
GENERATOR = 0xC75
LENGTH, CHECKS = 23, 11


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit; by remainder, the error patterns of up to four bits."""
    single = np.array([remainder(1 << b) for b in range(LENGTH)], dtype=np.int64)
    patterns = np.full((1 << CHECKS, 6), -1, dtype=np.int64)
    used = np.zeros(1 << CHECKS, dtype=np.int64)
    near = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight <= 3:
                near[s] = weight
            elif near[s] < 3:
                continue
            patterns[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return single, patterns


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices (12 bits) of 23-bit words; -1 where a word has one key."""
    single, patterns = _tables()
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), dtype=np.int64)
    for b in range(LENGTH):
        syndrome ^= (words >> b & 1) * single[b]
    errors = patterns[syndrome]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
