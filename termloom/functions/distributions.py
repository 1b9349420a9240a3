"""Upper tail probabilities for test statistics, applied to one-row results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.normal import normal_upper

_TINY = 1e-300
_EPS = 1e-15


def chi2_upper(x: float, dof: float) -> float:
    """P(X > x) for a chi-square variable."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= z / n
            total += term
        return 1.0 - total * scale
    return scale * _fraction(
        lambda i: (1.0 if i == 0 else -i * (i - a), z + 1.0 - a + 2.0 * i)
    )


def f_upper(x: float, dof1: float, dof2: float) -> float:
    """P(X > x) for an F variable."""
    if x <= 0:
        return 1.0
    return _beta(dof2 / (dof2 + dof1 * x), dof2 / 2.0, dof1 / 2.0)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1.0 - x, b, a)
    log_scale = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )

    def term(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 0:
            return 1.0, 1.0
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return math.exp(log_scale) * _fraction(term) / a


def _fraction(term, limit: int = 1_000_000) -> float:
    """Continued fraction a0/(b0 + a1/(b1 + …)) by the modified Lentz method."""
    value, c, d = _TINY, _TINY, 0.0
    for i in range(limit):
        a, b = term(i)
        d = b + a * d
        c = b + a / c
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        value *= step
        if i and abs(step - 1.0) < _EPS:
            return value
    raise ArithmeticError(f"no convergence after {limit} steps")


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(v, n) for v, n in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def f_p_value(x: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(v, n, m) for v, n, m in zip(x, dof1, dof2)])


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else normal_upper(v) for v in z], dtype="float64")
