"""Gaussian linear models over categorical factors.

A model of categorical factors depends on the data only through the count, mean and sum of
squares of each cell (combination of levels). One aggregation yields these for all models at
once. Tasks then add the cells up to the normal equations, so the driver sees sums whose size
depends on the number of coefficients, whatever the number of rows and cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.distributions import f_upper
from termloom.functions.multivariate_t import single_step
from termloom.operators.statistics import group_moments
from termloom.session import materialize

_CHUNK = 2_048  # cells whose design is built at a time


@dataclass(frozen=True)
class Cells:
    """Written sufficient statistics, one row per observed combination, and the levels."""

    factors: tuple[str, ...]
    levels: tuple[tuple, ...]
    table: DataFrame
    rows: int
    mean: float


def cell_statistics(
    rows: DataFrame, y: str, factors: Sequence[str], levels: Mapping[str, Sequence] | None = None
) -> Cells:
    """Aggregate to cells; ``levels`` fixes the order of a factor's levels."""
    table = materialize(group_moments(rows, y, factors), "cells")
    total = table.agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    ).first()
    orders = []
    for factor in factors:
        # Each level but one is a coefficient, so they are as few as the model's coefficients.
        seen = {row[0] for row in table.select(factor).distinct().toLocalIterator()}
        given = list((levels or {}).get(factor, sorted(seen)))
        orders.append(tuple(v for v in given if v in seen))
    return Cells(tuple(factors), tuple(orders), table, int(total["n"] or 0), float(total["mean"] or 0.0))


def all_terms(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """Main effects and all interactions, lower orders first."""
    return [
        term for size in range(1, len(factors) + 1)
        for term in itertools.combinations(factors, size)
    ]


def _coding(levels: Sequence, kind: str) -> tuple[np.ndarray, list[str]]:
    eye = np.eye(len(levels))
    if kind == "treatment":
        return eye[:, 1:], [str(v) for v in levels[1:]]
    if kind == "sum":
        coded = eye[:, :-1].copy()
        coded[-1, :] = -1.0
        return coded, [str(i + 1) for i in range(len(levels) - 1)]
    raise ValueError(f"unknown contrast {kind!r}")


class Design:
    """Columns of a model: their names, the term each belongs to, and their values per cell."""

    def __init__(self, cells: Cells, terms: Sequence[tuple[str, ...]], contrasts: Mapping[str, str]):
        self.factors, self.terms = cells.factors, list(terms)
        self.place = [{v: i for i, v in enumerate(own)} for own in cells.levels]
        self.coded = {
            f: _coding(own, contrasts.get(f, "treatment"))
            for f, own in zip(cells.factors, cells.levels)
            if any(f in term for term in terms)
        }
        self.names, self.owner = ["(Intercept)"], [()]
        for term in self.terms:
            labels = [[f"{f}{v}" for v in self.coded[f][1]] for f in term]
            for combination in itertools.product(*labels):
                self.names.append(":".join(combination))
                self.owner.append(term)

    def values(self, own: pd.DataFrame) -> np.ndarray:
        codes = {
            f: own[f].map(place).to_numpy(int)
            for f, place in zip(self.factors, self.place) if f in self.coded
        }
        blocks = [np.ones((len(own), 1))]
        for term in self.terms:
            block = np.ones((len(own), 1))
            for f in term:
                single = self.coded[f][0][codes[f]]
                block = (block[:, :, None] * single[:, None, :]).reshape(len(own), -1)
            blocks.append(block)
        return np.hstack(blocks)


@dataclass(frozen=True)
class Normal:
    """Normal equations: X'X, X'y, X'(y - mean), (y - mean)'(y - mean) and what cells leave over."""

    names: list[str]
    owner: list[tuple]
    xx: np.ndarray
    xy: np.ndarray
    xc: np.ndarray
    cc: float
    ss: float
    rows: int

    def part(self, index: list[int]) -> Normal:
        return Normal(
            [self.names[i] for i in index], [self.owner[i] for i in index],
            self.xx[np.ix_(index, index)], self.xy[index], self.xc[index], self.cc, self.ss, self.rows,
        )


def _normal(cells: Cells, terms: Sequence[tuple[str, ...]], contrasts: Mapping[str, str]) -> Normal:
    design = Design(cells, terms, contrasts)
    size, mean = len(design.names), cells.mean

    def add_up(frames):
        total = np.zeros(size * size + 2 * size + 2)
        for frame in frames:
            for low in range(0, len(frame), _CHUNK):
                own = frame.iloc[low : low + _CHUNK]
                x, n = design.values(own), own["n"].to_numpy(float)
                y = own["mean"].to_numpy(float)
                xn = x * n[:, None]
                total += np.concatenate(
                    [(x.T @ xn).reshape(-1), xn.T @ y, xn.T @ (y - mean),
                     [n @ (y - mean) ** 2, own["ss"].to_numpy(float).sum()]]
                )
        yield pd.DataFrame({"sums": [total.tobytes()]})

    total = np.zeros(size * size + 2 * size + 2)
    for row in cells.table.mapInPandas(add_up, "sums binary").toLocalIterator():
        total += np.frombuffer(row.sums)
    xx, rest = total[: size * size].reshape(size, size), total[size * size :]
    return Normal(
        design.names, design.owner, xx, rest[:size], rest[size : 2 * size],
        float(rest[-2]), float(rest[-1]), cells.rows,
    )


@dataclass(frozen=True)
class Fit:
    names: list[str]
    estimates: np.ndarray
    std_errors: np.ndarray
    rank: int
    rss: float
    rows: int
    covariance: np.ndarray

    @property
    def parameters(self) -> int:
        """Coefficients and the variance."""
        return self.rank + 1

    @property
    def log_likelihood(self) -> float:
        return -self.rows / 2 * (math.log(2 * math.pi * self.rss / self.rows) + 1)

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    @property
    def aicc(self) -> float:
        k = self.parameters
        return self.aic + 2 * k * (k + 1) / (self.rows - k - 1)


def _solve(own: Normal) -> Fit:
    values, vectors = np.linalg.eigh(own.xx)
    good = values > values.max() * len(values) * 1e-13
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
    rank = int(good.sum())
    centred = inverse @ own.xc
    rss = max(own.ss + own.cc - float(centred @ own.xc), own.ss)
    variance = rss / (own.rows - rank)
    errors = np.sqrt(np.maximum(np.diag(inverse), 0) * variance)
    return Fit(own.names, inverse @ own.xy, errors, rank, rss, own.rows, inverse * variance)


def fit_cells(
    cells: Cells,
    factors: Sequence[str],
    interactions: bool = True,
    contrasts: Mapping[str, str] | None = None,
) -> Fit:
    """Fit main effects of ``factors``, with all their interactions by default."""
    terms = all_terms(factors) if interactions else [(f,) for f in factors]
    return _solve(_normal(cells, terms, contrasts or {}))


def glm_fit(
    rows: DataFrame,
    y: str,
    factors: Sequence[str],
    interactions: bool = True,
    contrasts: Mapping[str, str] | None = None,
    levels: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """``term, estimate, std_error, t_value, p_value`` of one model."""
    cells = cell_statistics(rows, y, factors, levels)
    fit = fit_cells(cells, factors, interactions, contrasts)
    dof = fit.rows - fit.rank
    table = [
        (name, float(b), float(e), *((float(b / e), f_upper(float(b / e) ** 2, 1, dof)) if e else (None, None)))
        for name, b, e in zip(fit.names, fit.estimates, fit.std_errors)
    ]
    return rows.sparkSession.createDataFrame(
        table, "term string, estimate double, std_error double, t_value double, p_value double"
    )


def model_contrasts(
    rows: DataFrame,
    y: str,
    factors: Sequence[str],
    group: str,
    interactions: bool = True,
    contrasts: Mapping[str, str] | None = None,
    levels: Mapping[str, Sequence] | None = None,
    average: bool = False,
) -> DataFrame:
    """All differences between the levels of ``group`` in a fitted model, with adjusted p-values.

    ``group_a, group_b, difference, std_error, t_value, p_value, p_adjusted``; the difference is
    ``group_b`` less ``group_a``. It comes from the main effect of ``group``: with treatment
    contrasts of the other factors that is the difference at their first levels, with sum contrasts
    its mean over their levels. ``average`` takes the mean over all combinations of the other
    factors' levels whatever the contrasts. A contrast is a row of numbers l: its estimate is
    l'b, its variance l'Cl, and ``p_adjusted`` is the single-step p-value from the multivariate t
    distribution of all contrasts. A contrast that the data cannot tell (no error) has no t.
    """
    cells = cell_statistics(rows, y, factors, levels)
    terms = all_terms(factors) if interactions else [(f,) for f in factors]
    design = Design(cells, terms, contrasts or {})
    fit = _solve(_normal(cells, terms, contrasts or {}))
    own = cells.levels[cells.factors.index(group)]
    shares = {f: design.coded[f][0].mean(axis=0) for f in factors}

    def effect(code: np.ndarray) -> np.ndarray:
        """Columns of the model for a level of ``group``, the other factors at their mean or left out."""
        row = np.zeros(len(design.names))
        for term in terms:
            if group in term and (average or term == (group,)):
                block = np.ones(1)
                for f in term:
                    block = np.outer(block, code if f == group else shares[f]).ravel()
                row[[i for i, t in enumerate(design.owner) if t == term]] = block
        return row

    effects = [effect(code) for code in design.coded[group][0]]
    pairs = list(itertools.combinations(range(len(own)), 2))
    matrix = np.array([effects[j] - effects[i] for i, j in pairs]).reshape(len(pairs), len(design.names))
    difference, covariance = matrix @ fit.estimates, matrix @ fit.covariance @ matrix.T
    error = np.sqrt(np.maximum(np.diag(covariance), 0))
    known = np.flatnonzero(error > 0)
    dof = fit.rows - fit.rank
    t = np.full(len(pairs), np.nan)
    t[known] = difference[known] / error[known]
    correlation = covariance[np.ix_(known, known)] / np.outer(error[known], error[known])
    adjusted = dict(zip(known.tolist(), single_step(t[known], correlation, dof), strict=True)) if len(known) else {}
    table = [
        (own[i], own[j], float(difference[n]), float(error[n]),
         *((float(t[n]), f_upper(float(t[n]) ** 2, 1, dof), float(adjusted[n])) if n in adjusted else (None,) * 3))
        for n, (i, j) in enumerate(pairs)
    ]
    kind = dict(rows.dtypes)[group]
    return rows.sparkSession.createDataFrame(
        table,
        f"group_a {kind}, group_b {kind}, difference double, std_error double, t_value double, "
        "p_value double, p_adjusted double",
    )


def model_selection(
    rows: DataFrame,
    y: str,
    models: Mapping[str, Sequence[str]],
    contrasts: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Compare full factorial models by corrected AIC; one aggregation serves them all."""
    factors = sorted({f for own in models.values() for f in own})
    cells = cell_statistics(rows, y, factors)
    fits = {
        name: fit_cells(cells, own, contrasts=(contrasts or {}).get(name))
        for name, own in models.items()
    }
    best = min(fit.aicc for fit in fits.values())
    weights = {name: math.exp(-(fit.aicc - best) / 2) for name, fit in fits.items()}
    total = sum(weights.values())
    table = [
        (name, fit.parameters, fit.aic, fit.aicc, fit.aicc - best, weights[name] / total,
         fit.log_likelihood)
        for name, fit in fits.items()
    ]
    return rows.sparkSession.createDataFrame(
        table,
        "model string, parameters int, aic double, aicc double, delta double, "
        "weight double, log_likelihood double",
    ).orderBy("aicc", "model")


def anova_factorial(
    rows: DataFrame,
    y: str,
    factors: Sequence[str],
    kind: int = 2,
    contrasts: Mapping[str, str] | None = None,
) -> DataFrame:
    """F tests of the terms of the full factorial model.

    Type 2 compares the models with and without a term among all terms that do not contain it;
    type 3 removes only the term's own columns from the full model, so contrasts matter.
    """
    if kind not in (2, 3):
        raise ValueError("kind must be 2 or 3")
    cells = cell_statistics(rows, y, factors)
    terms = all_terms(factors)
    normal = _normal(cells, terms, contrasts or {})
    full = _solve(normal)
    error_df = full.rows - full.rank

    def fit(kept: list[tuple[str, ...]]) -> Fit:
        return _solve(
            normal.part([i for i, term in enumerate(normal.owner) if term == () or term in kept])
        )

    table = []
    for term in terms:
        if kind == 2:
            others = [t for t in terms if not set(term) <= set(t)]
            small, large = fit(others), fit([*others, term])
        else:
            small, large = fit([t for t in terms if t != term]), full
        dof = large.rank - small.rank
        ss = small.rss - large.rss
        f_value = (ss / dof) / (full.rss / error_df) if dof else None
        p_value = f_upper(f_value, dof, error_df) if dof else None
        table.append((":".join(term), float(ss), dof, f_value, p_value))
    table.append(("Residuals", full.rss, error_df, None, None))
    return rows.sparkSession.createDataFrame(
        table, "term string, sum_sq double, dof int, f_value double, p_value double"
    )
