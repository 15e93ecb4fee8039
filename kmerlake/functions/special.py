"""Special functions in plain Python, and pandas UDFs over them."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

READ_LENGTH = 150
SMALLEST = 1e-300


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for step in range(400):
        m = step // 2
        if step == 0:
            top = 1.0
        elif step % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of n draws of probability p."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    if n > 1000:
        return min(1.0, max(0.0, regularized_beta(p, k, n - k + 1)))
    lp, lq, whole = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = [whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k, n + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def upper_gamma(a: float, x: float) -> float:
    """Q(a, x), the regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if a == int(a) and x >= a + 1:
        # a finite sum, largest term first; each term is rounded by itself, which counts where the sum nears 0
        total, i = 0.0, int(a) - 1
        while i >= 0:
            term = math.exp(i * math.log(x) - x - math.lgamma(i + 1))
            total += term
            if term <= total * 1e-18:
                break
            i -= 1
        return total
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b or tiny)
        c = b + top / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 or df <= 0 else upper_gamma(df / 2, x / 2)


def binomial_pvalue(count: int, coverage: int, error: float) -> float:
    return 1.0 if count <= 0 or coverage <= 0 else binomial_sf(count, coverage, error)


def fisher_combine(pvalues: Iterable[float], k: int, read_length: int = READ_LENGTH) -> float:
    """Fisher's method; degrees of freedom are scaled for the overlap of k-mers of one read."""
    values = [min(1.0, max(p, SMALLEST)) for p in pvalues]
    if not values:
        return 1.0
    statistic = -2 * math.fsum(map(math.log, values))
    return chi2_sf(statistic, 2 * max(1.0, len(values) * min(1.0, k / read_length)))


def binomial_sf_col(k: Column, n: Column, p: Column) -> Column:
    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else binomial_sf(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")

    return run(k, n, p)


def chi2_sf_col(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), float(b)) for a, b in zip(x, df)], dtype="float64")

    return run(x, df)
