"""The perfect binary Golay code (23, 12): for a word of 23 bits the codewords near it, as 12-bit indices."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Codewords at distance 4 from a word that lies at distance 3 from its nearest one.
FARTHER = 5


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words after division by the generator."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK)), rest)
    return rest


@lru_cache(1)
def error_patterns() -> np.ndarray:
    """For each syndrome the errors that lead to near codewords: the only one of weight 0 to 3, and the five of weight 4 if that
    one has weight 3 (else 0 in these places, meaning none)."""
    table, filled = np.zeros((1 << CHECK, 1 + FARTHER), np.int64), np.ones(1 << CHECK, np.int64)
    weight = np.zeros(1 << CHECK, np.int64)
    for size in range(5):
        errors = np.array([sum(1 << i for i in places) for places in combinations(range(LENGTH), size)], np.int64)
        for error, at in zip(errors, syndromes(errors)):
            if size < 4:
                table[at, 0], weight[at] = error, size
            elif weight[at] == 3:
                table[at, filled[at]] = error
                filled[at] += 1
    return table


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices (n, 6) of the codewords near each word, and which of the six count.

    Two words that differ in at most two bits share one of their indices: a word within distance 2 of a codeword has that one
    alone, and any other word has its nearest codeword and all five at distance 4.
    """
    errors = error_patterns()[syndromes(words)]
    index = (words[:, None].astype(np.int64) ^ errors) >> CHECK
    counts = errors != 0
    counts[:, 0] = True
    return index, counts
