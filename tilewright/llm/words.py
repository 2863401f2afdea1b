"""Words of many texts at once as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_R to the powers 0 to n - 1, modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        step = out[k - 1 : k] * _R
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        k += m
    return out[:n]


def split_words(raw: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (a run of bytes other than ASCII white space) and its text's number, in order."""
    joined = np.frombuffer(b" ".join(raw), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~SPACE[joined]
    edge = np.diff(np.concatenate([[False], solid, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = ends - starts
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chars = joined[solid]
    value = _TABLE[LOWER[chars] if lower else chars] * powers(int(sizes.max()))[inner]
    hashes = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return mix(hashes + sizes.astype(np.uint64)), np.searchsorted(bounds, starts, side="right")


def count_distinct(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n groups has."""
    with np.errstate(over="ignore"):
        keys = mix(values + mix(groups.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(groups[first], minlength=n)
