"""Rolling hashes and trigger phrases of byte strings, for repeats of a fixed length.

Texts are laid end to end. Two polynomial prefix sums modulo 2**64 give the hash of any stretch in
constant time. The k-byte hash at a place is its rolling hash; a window's trigger is the place of the
smallest rolling hash among its first ``reach`` places (the first of equals). Triggers cut the text
into phrases, and as they only depend on the bytes of the window itself, equal windows have their
trigger, and thus their phrases, at the same offset.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
GRAM = 16


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a polynomial hash."""
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIERS[which] | 1))


class _Powers:
    """Powers of an odd base and of its inverse, grown when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._make(self.base, size), self._make(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _make(base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
        return out


_POWERS = tuple(_Powers(m | 1) for m in MULTIPLIERS)


class Hashes:
    """Hashes of any stretches of ``data`` (uint8) in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        up, self.down = _POWERS[which].get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(which)[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of data[start : start + length] for each start; the length is part of it."""
        start = np.asarray(start, np.int64)
        h = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(h + np.asarray(length, np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_argmin(values: np.ndarray, reach: int) -> np.ndarray:
    """For each i the place of the smallest of values[i : i + reach], the first of equals; places past the end don't count."""
    n = len(values)
    blocks = -(-(n + reach) // reach)
    place = np.arange(blocks * reach, dtype=np.uint64)
    low = np.uint64((1 << 26) - 1)
    if n > int(low):
        raise ValueError("too many bytes at once")
    tagged = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    tagged[:n] = values & ~low | place[:n]
    grid = tagged.reshape(blocks, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[reach - 1 : reach - 1 + n]) & low).astype(np.int64)


def phrase_windows(hashes: Hashes, starts: np.ndarray, ends: np.ndarray, length: int, reach: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger): runs of window starts with one trigger, for texts data[starts : ends].

    A window is ``length`` bytes within one text. Runs are in order and cover each window once.
    """
    n = len(hashes.sums) - 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    grams = hashes.of(np.arange(n - gram + 1), gram)
    trigger = sliding_argmin(grams, reach)
    sizes = np.maximum(ends - starts - length + 1, 0)
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    before = np.cumsum(sizes) - sizes
    p = np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)
    t = trigger[p]
    cut = np.ones(len(p), bool)
    cut[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(p)] - 1
    return p[first], p[last], t[first]


def split_zones(first: np.ndarray, last: np.ndarray, trigger: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part runs by the distance of start and trigger: zone z has distances from z * width to z * width + width - 1.

    Returns (first, last, trigger, zone) of the parts.
    """
    low, high = (trigger - last) // width, (trigger - first) // width
    count = high - low + 1
    rows = np.repeat(np.arange(len(first)), count)
    zone = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + low[rows]
    t = trigger[rows]
    return np.maximum(first[rows], t - zone * width - width + 1), np.minimum(last[rows], t - zone * width), t, zone


