"""Tail probabilities on arrays, for the last few rows of a test."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_TINY = 1e-300


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    keep = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(z), 1 / keep(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 10_000):
        step = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / keep(1 + step * d), keep(1 + step / c)
        f *= d * c
        step = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / keep(1 + step * d), keep(1 + step / c)
        f *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p value of a (rank) correlation of n pairs by Student's t; no number under three pairs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    ok = (n >= 3) & np.isfinite(r)
    free = np.where(ok, n - 2, 1.0)
    p = beta_share(free / 2, np.full_like(free, 0.5), np.clip(1 - np.where(ok, r, 0.0) ** 2, 0.0, 1.0))
    return np.where(ok, p, np.nan)


@lru_cache(maxsize=64)
def _rank_sums(n: int) -> tuple[int, ...]:
    """For each sum, how many subsets of the ranks 1 to n have it or less."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for i, c in enumerate(counts):
            longer[i + rank] += c
        counts = longer
    total, upto = 0, []
    for c in counts:
        total += c
        upto.append(total)
    return tuple(upto)


def signed_rank_exact(w: int, n: int) -> float:
    """Two-sided p value of a signed-rank sum w of n differences without ties or zeros: all 2^n signs are as likely."""
    upto = _rank_sums(n)
    w = min(w, n * (n + 1) // 2 - w)
    return min(1.0, 2 * upto[w] / 2**n)
