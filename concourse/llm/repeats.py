"""Rolling names of byte strings and the anchors of their windows (numpy helpers of suffix-array dedup)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ._shared import mix64

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        fwd = np.full(n, _BASE, np.uint64)
        inv = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        fwd[0] = inv[0] = 1
        return np.multiply.accumulate(fwd), np.multiply.accumulate(inv)


_BYTE = np.random.default_rng(8).integers(0, 2**64, 256, np.uint64)


class Names:
    """Names of substrings of data: equal strings of one length have equal 64-bit names."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        size = 1 << max(20, n.bit_length())
        fwd, self.inv = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * fwd[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64(((self.sums[stop] - self.sums[start]) * self.inv[start]) ^ (stop - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64(((self.sums[k:] - self.sums[:n]) * self.inv[:n]) ^ np.uint64(k))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Each window of `length` bytes has one anchor: the leftmost of its k-byte strings with the smallest name, so equal windows have it at one offset.

    data holds texts end to end, ends where each stops. Returns name, position, first and last window start of each run of windows with one anchor.
    """
    n = len(data)
    if n < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    every = Names(data).every(k)
    bits = np.uint64(max(1, len(every).bit_length()))
    low = (every >> bits << bits) | np.arange(len(every), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[span:], low[:-span])
        span *= 2
    if width > span:
        low = np.minimum(low[width - span :], low[: -(width - span)])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(at))
    text = np.searchsorted(ends, start, side="right")
    keep = np.flatnonzero(start + length <= ends[text])
    if not len(keep):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    at = at[keep]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return every[at[first]], at[first], keep[first], keep[last]
