"""The perfect binary Golay code of length 23, as a fuzzy hash for words of 23 bits.

Every word lies within distance 3 of exactly one codeword. The keys of a word are the codewords of
all words within distance 1 of it: one if it lies within distance 2 of its codeword, else six. Two
words within distance 2 of each other have a word within distance 1 of both, hence a common key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DIMENSION, CHECKS = 23, 12, 11
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
WIDTH = 6


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial."""
    rest = words.astype(np.int32)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - CHECKS), rest)
    return rest


def _errors() -> np.ndarray:
    """The error pattern of weight 3 or less of each syndrome."""
    table = np.zeros(1 << CHECKS, np.int32)
    for weight in (1, 2, 3):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int32)
        table[syndromes(patterns)] = patterns
    return table


ERRORS = _errors()
_FLIPS = np.array([0, *(1 << b for b in range(LENGTH))], np.int32)
_FLIP_SYNDROMES = syndromes(_FLIPS)


def decode(words: np.ndarray) -> np.ndarray:
    """The index of the nearest codeword: its 12 message bits."""
    return (words.astype(np.int32) ^ ERRORS[syndromes(words)]) >> CHECKS


def keys(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(indices, valid)`` of shape (n, 6): the distinct keys of each word; only the low ``bits`` vary."""
    flips = slice(0, bits + 1)
    around = words.astype(np.int32)[:, None] ^ _FLIPS[None, flips]
    found = (around ^ ERRORS[syndromes(words)[:, None] ^ _FLIP_SYNDROMES[None, flips]]) >> CHECKS
    found = np.sort(found, axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    out, valid = np.zeros((len(words), WIDTH), np.int64), np.zeros((len(words), WIDTH), bool)
    row, column = np.nonzero(fresh)
    place = np.cumsum(fresh, axis=1)[row, column] - 1
    out[row, place], valid[row, place] = found[row, column], True
    return out, valid
