"""Word shingles as hash sets, and circulant MinHash signatures of them.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, which is
what ``bytes.lower().split()`` yields on the UTF-8 bytes. A shingle is a run of
``width`` words, held as a 64-bit hash; a text with fewer words is one shingle.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Odd multipliers, one for each place of a word in its shingle.
PLACES = np.array([2 * (0x9E3779B97F4A7C15 * (k + 1) % 2**62) + 1 for k in range(16)], dtype=np.uint64)
CACHE = 500_000


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when it holds ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, cache: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = hashes[: len(hashes) - width + 1] * PLACES[0]
    for k in range(1, width):
        total = total + hashes[k : len(hashes) - width + 1 + k] * PLACES[k]
    return np.unique(mix(total + np.uint64(width)))


def scramble(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers: two multiply-xorshift rounds."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(a)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` MinHash values of each nonempty set, out of two permutations.

    The first permutation places every element on a circle of 2**32 positions.
    Coordinate k is the least value that the second permutation, shifted by k
    places on that circle, gives to an element of the set.
    """
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    places = scramble((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((size, len(sets)), np.uint32)
    for k in range(size):
        np.minimum.reduceat(scramble(places + np.uint32(k), 0x2C1B3C6D, 0x297A2D39), starts, out=out[k])
    return out.T


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, on whole sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
