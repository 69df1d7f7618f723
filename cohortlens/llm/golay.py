"""The perfect binary Golay code of length 23: anchors that cover 23 bits within radius 3.

Every 23-bit word lies within 3 bits of exactly one of the 4,096 code words. A
word's anchors within radius 3 + t are found from its syndrome (its remainder
by the generator polynomial): they are the word with one of the error patterns
of that syndrome and of at most 3 + t bits flipped.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, RADIUS = 23, 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the published generator polynomial.
GENERATOR, DEGREE = 0b101011100011, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, DEGREE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - DEGREE)
    return word


@cache
def _bit_syndromes() -> np.ndarray:
    return np.array([_remainder(1 << b) for b in range(LENGTH)], dtype=np.int64)


def syndromes(words: np.ndarray) -> np.ndarray:
    """The syndrome of each 23-bit word."""
    out = np.zeros(len(words), dtype=np.int64)
    for bit, s in enumerate(_bit_syndromes()):
        out ^= np.where(words >> bit & 1, s, 0)
    return out


@cache
def patterns(ring: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns by syndrome: (start of each syndrome's patterns, the patterns).

    Ring 0 has the patterns of up to RADIUS bits (one for each syndrome), ring t
    those of exactly RADIUS + t bits.
    """
    weights = range(RADIUS + 1) if ring == 0 else [RADIUS + ring]
    found = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], dtype=np.int64)
    of = syndromes(found)
    by = np.argsort(of, kind="stable")
    return np.searchsorted(of[by], np.arange((1 << DEGREE) + 1)), found[by]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1 of all i, in turn."""
    total = int(counts.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else np.zeros(0, np.int64)
    return first + np.arange(total)


def anchors(words: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) for every code word of that ring around each word."""
    starts, found = patterns(ring)
    s = syndromes(words)
    counts = starts[s + 1] - starts[s]
    rows = np.repeat(np.arange(len(words)), counts)
    return rows, words[rows] ^ found[ragged(starts[s], counts)]
