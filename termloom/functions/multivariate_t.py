"""Tail of the largest of several correlated t variables, for single-step adjusted p-values.

The variables are ``A z / s`` with a normal vector z and a common chi variable s. Given the
direction of z, the largest of them exceeds c exactly if an F variable exceeds a number that
depends on c and the direction alone. So only directions are averaged, over a shifted lattice
(quasi-Monte-Carlo), and small p-values are as exact as large ones.
"""

from __future__ import annotations

import math

import numpy as np

from termloom.functions.normal import normal_quantiles

POINTS, SHIFTS, SEED = 4096, 8, 241
_PRIMES = [2]
_PIECE = 1 << 20


def _primes(count: int) -> np.ndarray:
    candidate = _PRIMES[-1]
    while len(_PRIMES) < count:
        candidate += 1
        if all(candidate % p for p in _PRIMES):
            _PRIMES.append(candidate)
    return np.array(_PRIMES[:count], float)


def f_uppers(x: np.ndarray, dof1: float, dof2: float) -> np.ndarray:
    """P(X > x) of an F variable for an array, by the continued fraction of the beta integral."""
    z = dof2 / (dof2 + dof1 * np.maximum(x, 0.0))
    a, b = dof2 / 2.0, dof1 / 2.0
    turned = z > (a + 1) / (a + b + 2)
    out = np.empty(len(z))
    for side, own, p, q in ((False, ~turned, a, b), (True, turned, b, a)):
        v = 1.0 - z[own] if side else z[own]
        value = _beta(v, p, q)
        out[own] = 1.0 - value if side else value
    return out


def _beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta where its continued fraction converges fast."""
    tiny = 1e-300
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    c = np.ones(len(x))
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) > tiny, 1 - (a + b) * x / (a + 1), tiny)
    value = d.copy()
    for m in range(1, 2000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) > tiny, d, tiny)
            c = 1.0 + term / c
            c = np.where(np.abs(c) > tiny, c, tiny)
            step = c * d
            value *= step
        if not len(x) or np.max(np.abs(step - 1.0)) < 1e-14:
            break
    return front * value / a


def single_step(statistics: np.ndarray, correlation: np.ndarray, dof: float) -> np.ndarray:
    """P(largest |T| ≥ |t|) for each t, with T multivariate t of the given correlation."""
    values, vectors = np.linalg.eigh(correlation)
    good = values > max(values.max(), 0) * len(values) * 1e-12
    factor = vectors[:, good] * np.sqrt(values[good])
    rank = factor.shape[1]
    if rank == 0:
        return np.ones(len(statistics))
    t = np.abs(np.asarray(statistics, float))
    if rank == 1:  # all are one variable
        largest = np.full(1, np.abs(factor).max())
    else:
        shift = np.random.default_rng(SEED).random((SHIFTS, 1, rank))
        lattice = np.arange(1, POINTS + 1)[None, :, None] * np.sqrt(_primes(rank)) + shift
        folded = np.abs(2.0 * (lattice % 1.0) - 1.0).reshape(-1, rank)
        z = normal_quantiles(np.clip(folded, 1e-12, 1 - 1e-12))
        z /= np.linalg.norm(z, axis=1)[:, None]
        largest = np.concatenate([
            np.abs(part @ factor.T).max(axis=1)
            for part in np.array_split(z, max(1, len(z) * len(t) // _PIECE))
        ])
    return np.array([float(f_uppers((x / largest) ** 2 / rank, rank, dof).mean()) for x in t])
