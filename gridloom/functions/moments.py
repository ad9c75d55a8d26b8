"""Sample statistics that Spark has no single function for, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_g1(c) -> Column:
    """Bias-corrected skewness G1; null below three values, zero for a constant column."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g1 = F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(F.skewness(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c) -> Column:
    """Bias-corrected excess kurtosis G2; null below four values, zero for a constant column."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(corrected))


def k_squared(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson K2 from the count and the population skewness / excess kurtosis."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    expected = -6 / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - expected) / F.sqrt(var)
    root = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    term = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = ((1 - 2 / (9 * a)) - F.signum(term) * F.pow(F.abs(term), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return z_skew * z_skew + z_kurt * z_kurt


def chi2_sf_2df(x: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom (closed form)."""
    return F.exp(-x / 2)


def pooled_sd(var_a: Column, var_b: Column) -> Column:
    """Root of the mean of two variances."""
    return F.sqrt((var_a + var_b) / 2)


def correlation_of(a: str | Column, b: str | Column) -> Column:
    """Pearson r over the rows where both are present; null if either does not vary (the built-in aggregate stops there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
