"""Sets of word shingles as 64-bit hashes, computed over whole Arrow text columns with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a sum
of random byte weights times powers of an odd base, modulo 2**64, followed by a mixing step; a shingle's hash
chains the hashes of its words. Two different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.default_rng(20240229)
_WEIGHT = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WEIGHT[65:91] = _WEIGHT[97:123]
_WEIGHT[_SPACE] = 0
_POWER_BITS = 12
_POWER = np.cumprod(np.full(1 << _POWER_BITS, 0x9E3779B97F4A7C15, np.uint64))
_STEP = 1 << 20
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def segment_hashes(data: np.ndarray, starts: np.ndarray, end: int, weight: np.ndarray) -> np.ndarray:
    """Hash of each segment of data from one start to the next (the last ends at end), by these byte weights."""
    bounds = np.append(starts, end)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _STEP)))
        own = starts[at:to]
        lo, hi = own[0], bounds[to]
        place = np.arange(hi - lo) - np.repeat(own - lo, bounds[at + 1 : to + 1] - own)
        value = weight[data[lo:hi]] * _POWER[place & ((1 << _POWER_BITS) - 1)]
        out[at:to] = np.add.reduceat(value, own - lo)
        at = to
    return mix(out)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of all rows begin; a row's end ends a word."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    return np.flatnonzero(begins)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all rows in order, and the n + 1 offsets of the rows' words."""
    starts = word_starts(data, offsets)
    return segment_hashes(data, starts, len(data), _WEIGHT), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than width: the whole sequence as one; no words: empty."""
    words, at = word_hashes(data, offsets)
    n = len(words) - width + 1
    chained = words[: max(n, 0)]
    for j in range(1, width):
        chained = mix(chained * _C + words[j : j + n]) if n > 0 else chained
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            own = np.sort(chained[a : b - width + 1])
            if len(own) > 1:
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                own = own[fresh]
            yield own
        elif b > a:
            own = words[a : a + 1]
            for j in range(a + 1, b):
                own = mix(own * _C + words[j : j + 1])
            yield mix(own + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
