"""Words of a text as numpy arrays.

A word is a maximal run of bytes other than ASCII white space (space, \\t \\n \\v \\f \\r) of the
UTF-8 text. Its 64-bit hash is a polynomial over its bytes, taken for all words at once from one
cumulative sum, then mixed. Long texts are handled in blocks that end at white space.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of bytes."""
    n = len(b)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _block_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b)
    gap = SPACE[b]
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, last = ([0] if not gap[0] else []), ([n] if not gap[-1] else [])
    bounds = np.concatenate([first, turns, last]).astype(np.int64)
    starts, ends = bounds[0::2], bounds[1::2]
    return starts, ends, slice_hashes(b, starts, ends)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets (start, end) and 64-bit hashes of the words of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(b) <= BLOCK:
        return _block_words(b)
    parts, at = [], 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        while end < len(b) and not SPACE[b[end]]:
            end += 1
        s, e, h = _block_words(b[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-word windows of a sequence of word hashes; none for a shorter sequence."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(_BASE)
        out += h[i : i + m]
    return mix(out)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter sequence of words is one shingle, no words are none."""
    if 0 < len(h) < n:
        return windows(h, len(h))
    return np.unique(windows(h, n))
