"""Vectorised kernels over the bytes of many texts at once.

A block is a byte array with the offsets of its texts.  Hashes are sums of the
bytes' values, each times the factor of its place, modulo 2**64; values and
factors are fixed numbers without a pattern (multilinear hashing).  So equal
byte strings have equal hashes in every process, and different ones, also those
that differ in a regular way, have the same hash by a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_factors = np.ones(0, np.uint64)
#: Factors of the members of an n-gram.
FACTORS = mix(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def factors(n: int) -> np.ndarray:
    """The factors of the first n places."""
    global _factors
    if len(_factors) < n:
        size = max(n, 2 * len(_factors), 4096)
        _factors = mix(np.arange(5_000, 5_000 + size, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    return _factors[:n]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True within each text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    end[cuts] = inside[cuts]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each of the disjoint, ascending, non-empty ranges of data."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    where = np.arange(int(sizes.sum()), dtype=np.int64)
    within = where - np.repeat(first, sizes)
    where += np.repeat(starts - first, sizes)
    values = _VALUES[data[where]] * factors(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, first))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each place of one sequence of word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count] * FACTORS[0]
    for k in range(1, n):
        total = total + words[k : k + count] * FACTORS[k]
    return mix(total)


class Rolling:
    """Hashes of the n-grams of any length at each place of a sequence of word
    hashes, all from one pass: a polynomial rolls over the words, and an n-gram's
    value is the difference of two of its sums, moved to place 0."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        ahead, back = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        ahead[:1] = back[:1] = 1
        self.back = np.cumprod(back)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(ahead))])

    def __call__(self, n: int) -> np.ndarray:
        if len(self.total) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.total[n:] - self.total[:-n]) * self.back[: len(self.total) - n])


def owners(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each place belongs to."""
    return np.searchsorted(offsets, places, "right") - 1


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of whole-number values by owner."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for the keys that occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """True for the keys that equal an earlier key."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    order = np.argsort(keys, kind="stable")
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out
