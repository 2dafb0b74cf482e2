"""Words of whole text batches as arrays: positions, hashes and hashes of word windows.

A hash is a polynomial over random 64-bit symbols modulo 2^64, mixed at the end;
``seed`` selects one of a family, so two seeds make a 128-bit fingerprint.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def symbols(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919 + 1))


def factor(seed: int) -> np.uint64:
    return symbols(seed)[0] | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    if len(edges):
        before[edges] = False
        after[edges - 1] = False  # the last byte of the text before; index -1 is the last of all
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    table, base = symbols(seed), factor(seed)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE, "right")))
        begin, end = starts[first], ends[last - 1]
        piece, at = data[begin:end], starts[first:last] - begin
        place = np.arange(end - begin) - np.repeat(at, np.diff(np.append(at, end - begin)))
        values = table[piece] * powers(base, int(place.max()) + 1)[place]
        values[_SPACE[piece]] = 0
        out[first:last] = mix(np.add.reduceat(values, at) + (ends[first:last] - starts[first:last]).astype(np.uint64))
        first = last
    return out


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start indexes of all windows of ``width`` words inside one text, and the windows' hashes."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - width + 1, np.uint64)
    base = factor(seed)
    if width <= 8:
        for weight, shift in zip(powers(base, width), range(width)):
            total += hashes[shift:n - width + 1 + shift] * weight
    else:
        scale = powers(base, n)
        inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), n - width + 1)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashes * scale)])
        total = (prefix[width:] - prefix[:-width]) * inverse
    inside = np.ones(n, bool)  # a start needs width words before its text ends
    ends = first[1:][np.diff(first) > 0]
    for back in range(1, width):
        cut = ends - back
        inside[cut[cut >= 0]] = False
    starts = np.flatnonzero(inside[:n - width + 1])
    return starts, mix(total[starts])
