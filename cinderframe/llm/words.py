"""Vectorised 64-bit hashes of words and word shingles over chunks of UTF-8 text.

A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, then
mixed. All steps are array operations over a bounded chunk of whole texts.
"""

from __future__ import annotations

import numpy as np

from cinderframe.llm.shared import by_value

by_value(__name__)

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed))


def space_separated() -> np.ndarray:
    """True for bytes of words between ASCII white space."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return inside


def alphanumeric() -> np.ndarray:
    """True for ASCII letters, digits and all bytes of other scripts."""
    inside = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[a:b] = True
    return inside


def byte_codes() -> np.ndarray:
    """A random value per byte, equal for A-Z and a-z."""
    codes = numbers(256, 7)
    codes[65:91] = codes[97:123]
    return codes


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class WordHasher:
    """Finds the words of a chunk and hashes them; holds tables that grow to the longest chunk."""

    def __init__(self, inside: np.ndarray):
        self.inside, self.codes = inside, byte_codes()
        self.up = self.down = np.zeros(0, U)

    def spans(self, data: np.ndarray, bounds: np.ndarray):
        """Starts and ends of words; a bound between texts always ends a word."""
        word = self.inside[data]
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        starts[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self, data: np.ndarray, bounds: np.ndarray):
        """(starts, ends, hashes, index of each text's first word)."""
        if len(data) > len(self.up):
            n = max(len(data), 1 << 20)
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)
        starts, ends = self.spans(data, bounds)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U)) if len(starts) else np.zeros(0, U)
        return starts, ends, hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text: ``size`` words, or all words where there are fewer."""
    factors = numbers(size, 11) | U(1)
    n = len(hashes)
    joined = np.zeros(max(n - size + 1, 0), U)
    for k in range(size):
        joined += hashes[k : n - size + 1 + k] * factors[k] if n >= size else U(0)
    joined = mix(joined)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            sets.append(mix(np.array([(hashes[a:b] * factors[: b - a]).sum(dtype=U) + U(b - a)], U)))
        else:
            sets.append(joined[:0])
    return sets
