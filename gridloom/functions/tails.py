"""Tail probabilities of the t, F, chi-square and normal laws for aggregate rows.

They run as Arrow-batched functions over *results* (a handful of rows), never over input rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coef in (even, odd):
            d = 1.0 + coef * d
            c = 1.0 + coef / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1.0) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    out = d
    for i in range(1, 20000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def t_two_sided_value(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf_value(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf_value(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def normal_two_sided_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kendall_exact_value(n: float, inversions: float) -> float:
    """Two-sided p of a rank order of ``n`` values with so many inversions, from the inversion-count law."""
    n, top = int(n), int(n * (n - 1) // 2)
    c = int(min(inversions, top - inversions))
    if 4 * c == n * (n - 1):
        return 1.0
    ways = np.zeros(c + 1)
    ways[0] = 1.0
    for k in range(2, n + 1):
        sums = np.cumsum(ways)
        ways = sums - np.concatenate([np.zeros(min(k, c + 1)), sums[: max(c + 1 - k, 0)]])
        ways /= k
    return min(1.0, 2.0 * float(ways.sum()))


def _each(fn, *series: pd.Series) -> pd.Series:
    """Apply a scalar tail over rows, keeping nulls and undefined inputs null."""
    rows = zip(*(s.astype("float64") for s in series))
    return pd.Series(
        [fn(*r) if all(np.isfinite(v) for v in r) and all(v > 0 for v in r[1:]) else None for r in rows],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided_value, t, df)


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_sf_value, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_sf_value, x, df)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided_value, z)


@F.pandas_udf(DoubleType())
def kendall_exact_p(n: pd.Series, inversions: pd.Series) -> pd.Series:
    return pd.Series([kendall_exact_value(a, b) for a, b in zip(n, inversions)], dtype="float64")
