"""Distribution functions that the estimators need: plain Python on the driver, and erf as a column."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_ppf(q: float) -> float:
    return _NORMAL.inv_cdf(q)


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function P(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(x / 2, df / 2)


def chi2_ppf(q: float, df: float) -> float:
    """Inverse of chi2_cdf by bisection to machine precision (exact forms for 1 and 2 degrees)."""
    if not 0 <= q < 1:
        return math.inf if q == 1 else math.nan
    if q == 0:
        return 0.0
    if df == 1:
        return norm_ppf((1 + q) / 2) ** 2
    if df == 2:
        return -2 * math.log1p(-q)
    low, high = 0.0, max(1.0, df)
    while chi2_cdf(high, df) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if chi2_cdf(mid, df) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def erf(x: Column) -> Column:
    """erf(x) by its confluent series as a fold over a fixed range; 1 beyond 6."""
    y = F.abs(x)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, n: Column) -> Column:
        t = a["t"] * y * y / (n + F.lit(0.5))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, add, lambda a: a["s"])
    return F.signum(x) * F.when(y > 6, 1.0).otherwise(y * F.exp(-y * y) * (2 / math.sqrt(math.pi)) * series)


def chi2_1_cdf_of_square(r: Column) -> Column:
    """P(chi-square with one degree <= r^2)."""
    return erf(F.abs(r) / math.sqrt(2))
