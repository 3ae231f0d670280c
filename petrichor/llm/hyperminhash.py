"""HyperMinHash registers: leading-zero count and mantissa bits of each bucket's smallest hash.

Buckets are equal ranges of the 64-bit hash, so in a sorted set the first hash at or after a bucket's lower end is its
minimum. A register holds 6 bits of leading-zero count and ``MANTISSA`` bits after the leading one; zero is an empty bucket.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .text import mix

MANTISSA = 10
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int) -> np.uint64:
    return np.uint64((n * 0x9E3779B97F4A7C15) & (1 << 64) - 1)


@lru_cache(maxsize=8)
def _bounds(buckets: int) -> np.ndarray:
    step = (1 << 64) // buckets
    return np.array([i * step for i in range(buckets)], dtype=np.uint64)


def registers(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """uint16 registers, one row a set; 0 is an empty bucket."""
    low, step = _bounds(buckets), (1 << 64) // buckets
    out = np.zeros((len(sets), buckets), dtype=np.uint16)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, low)
            inside = at < np.append(at[1:], len(s))
            v = (s[at[inside]] - low[inside]).astype(np.float64) / step
            m, e = np.frexp(np.maximum(v, 2.0 ** -62))  # v = m * 2**e with m in [0.5, 1)
            zeros = np.minimum(-e, 61)
            mantissa = ((m - 0.5) * (2 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
            out[i, inside] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
    return out


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill empty buckets for banding: borrow from hashed buckets, at last from the next filled one in order.

    Equal borrowing order for all sets keeps the chance of two equal registers near the Jaccard similarity also where
    a set has fewer shingles than there are buckets.
    """
    n, k = regs.shape
    out = regs.astype(np.uint32)
    some = regs.any(axis=1)
    cols = np.arange(k, dtype=np.uint64)
    for attempt in range(1, 25):
        hole = (out == 0) & some[:, None]
        if not hole.any():
            return out
        target = (mix(cols * np.uint64(64) + _odd(attempt)) % np.uint64(k)).astype(np.int64)
        got = regs[:, target]
        take = hole & (got != 0)
        out[take] = (got.astype(np.uint32) + np.uint32(attempt << 16))[take]
    for i in np.flatnonzero(((out == 0) & some[:, None]).any(axis=1)):
        filled = np.flatnonzero(regs[i])
        hole = np.flatnonzero(out[i] == 0)
        nxt = filled[np.searchsorted(filled, hole) % len(filled)]
        out[i, hole] = regs[i, nxt].astype(np.uint32) + np.uint32(25 << 16)
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of each band of ``rows`` registers; the band number is part of the key."""
    dense = densify(regs).astype(np.uint64)
    n, k = dense.shape
    count = k // rows
    key = np.broadcast_to(mix((np.arange(count, dtype=np.uint64) + np.uint64(1)) * _GOLD), (n, count)).copy()
    for r in range(rows):
        key = mix(key ^ (dense[:, r: count * rows: rows] + _odd(r + 1)))
    return key.view(np.int64)


@lru_cache(maxsize=4)
def _accidental(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two unrelated sets fill one bucket with equal registers, on a grid of set sizes."""
    sizes = np.unique(np.round(2.0 ** np.arange(0, 34, 0.5)))
    zeros = np.arange(0, 62)[:, None]
    frac = np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA)
    lo = (2.0 ** -(zeros + 1.0) * (1 + frac)).ravel()
    hi = (2.0 ** -(zeros + 1.0) * (1 + frac + 1.0 / (1 << MANTISSA))).ravel()
    p = np.empty((len(sizes), len(lo)), dtype=np.float64)
    for i, n in enumerate(sizes):
        lam = n / buckets  # hashes in a bucket: Poisson, so the minimum is past x with chance exp(-lam * x)
        p[i] = (np.exp(-lam * lo) - np.exp(-lam * hi)) / max(1e-300, -np.expm1(-lam))
    return sizes, p @ p.T


def estimate(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of row pairs, and the number of buckets each rests on."""
    sizes, table = _accidental(a.shape[-1])
    both, either = (a != 0) & (b != 0), (a != 0) | (b != 0)
    same = ((a == b) & both).sum(axis=-1)
    used = np.maximum(either.sum(axis=-1), 1)
    ia, ib = (np.clip(np.searchsorted(sizes, n), 0, len(sizes) - 1) for n in (na, nb))
    c = table[ia, ib]
    shared = both.sum(axis=-1)
    # same = true + c * (shared - true)
    return np.clip((same - c * shared) / (1 - c), 0, None) / used, used


def passes(estimated: np.ndarray, used: np.ndarray, threshold: float, deviations: float = 6.0) -> np.ndarray:
    """Keep what is not ``deviations`` standard errors below the threshold."""
    return estimated >= threshold - deviations * np.sqrt(threshold * (1 - threshold) / used)
