"""P-values from sample sizes and a statistic alone: small rows after the aggregation, never the data."""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_KS, EXACT_CVM = 10_000, 20


def chi2_survival(x: float, df: int) -> float:
    """P(X >= x) of chi-square with df degrees: the regularised upper incomplete gamma function Q(df/2, x/2)."""
    if df < 1 or not x > 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of P
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * scale)
    b = z + 1 - a  # continued fraction of Q, by Lentz
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def kolmogorov_survival(t: float) -> float:
    """P(K >= t) of Kolmogorov's limit law."""
    if t < 0.18:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


@lru_cache(4096)
def ks_exact(n: int, m: int, d: float) -> float:
    """P(D >= d) for samples of n and m without ties: one less the share of lattice paths that stay inside.

    Walks the anti-diagonals of the lattice; a cell holds the share of paths to it that stayed inside so far.
    """
    reach = round(d * n * m)
    if reach <= 0:
        return 1.0
    share = np.zeros(n + 1)
    share[0] = 1.0
    for k in range(1, n + m + 1):
        lo, hi = max(0, k - m), min(n, k)
        i = np.arange(lo, hi + 1)
        below = np.where(i > 0, share[np.maximum(i - 1, 0)], 0.0) * i / k
        left = np.where(k - i > 0, share[i], 0.0) * (k - i) / k
        inside = np.abs(i * m - (k - i) * n) < reach
        share[:] = 0.0
        share[lo : hi + 1] = np.where(inside, below + left, 0.0)
    return float(min(1.0, max(0.0, 1 - share[n])))


def ks_pvalue(n: int, m: int, d: float) -> float:
    """Exact up to EXACT_KS a side, Kolmogorov's limit beyond."""
    if max(n, m) <= EXACT_KS:
        return ks_exact(int(n), int(m), float(d))
    return kolmogorov_survival(d * math.sqrt(n * m / (n + m)))


def _bessel_k_quarter(z: float) -> float:
    """Modified Bessel function K of order 1/4, by its integral over exp(-z cosh t) cosh(t / 4)."""
    top = math.acosh(1 + 700 / z)
    t = np.linspace(0, top, 2001)
    y = np.exp(-z * np.cosh(t)) * np.cosh(t / 4)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (t[1] - t[0]) / 3)


def cvm_limit_cdf(x: float) -> float:
    """Limit law of the Cramer-von Mises statistic."""
    if x <= 0:
        return 0.0
    total = 0.0
    for k in range(20):
        y = (4 * k + 1) ** 2 / (16 * x)
        if y > 600:
            break
        weight = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) * math.sqrt(4 * k + 1)
        total += weight * math.exp(-y) * _bessel_k_quarter(y)
    return min(1.0, total / (math.pi**1.5 * math.sqrt(x)))


@lru_cache(256)
def _cvm_law(n: int, m: int) -> tuple[tuple[int, int], ...]:
    """(sum of squared lattice deviations, paths) over all orders of n and m values."""
    row: list[dict[int, int]] = [{} for _ in range(m + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                row[0] = {0: 1}
                continue
            own = (i * m - j * n) ** 2
            cell: dict[int, int] = {}
            for source in ([row[j]] if i else []) + ([row[j - 1]] if j else []):
                for value, paths in source.items():
                    cell[value + own] = cell.get(value + own, 0) + paths
            row[j] = cell
    return tuple(row[m].items())


def cvm_pvalue(n: int, m: int, t: float) -> float:
    """Exact up to EXACT_CVM a side, else by the limit law of the standardised statistic."""
    n, m = int(n), int(m)
    total = n + m
    if max(n, m) <= EXACT_CVM:
        seen = round(t * n * m * total * total)
        law = _cvm_law(n, m)
        return sum(p for v, p in law if v >= seen) / sum(p for _, p in law)
    mean = (1 + 1 / total) / 6
    variance = (total + 1) * (4 * n * m * total - 3 * (n * n + m * m) - 2 * n * m) / (45 * total * total * 4 * n * m)
    x = 1 / 6 + (t - mean) / math.sqrt(45 * variance)
    return 1.0 if x < 0.003 else max(0.0, 1 - cvm_limit_cdf(x))


def _over_rows(f):  # the argument order is that of f
    @F.pandas_udf("double")
    def rows(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(z) else f(int(x), int(y), float(z)) for x, y, z in zip(a, b, c, strict=True)], dtype=float)

    return rows


def ks_p(n: Column, m: Column, d: Column) -> Column:
    return _over_rows(ks_pvalue)(n, m, d)


def cvm_p(n: Column, m: Column, t: Column) -> Column:
    return _over_rows(cvm_pvalue)(n, m, t)


def chi2_p(statistic: Column, df: Column) -> Column:
    return _over_rows(lambda k, _, x: chi2_survival(x, k))(df, df, statistic)


def ks_p_limit(n: Column, m: Column, d: Column) -> Column:
    """Kolmogorov's limit as an expression, ten terms; within code generation."""
    z = -2 * n * m / (n + m) * d * d
    terms = sum(((-1) ** (k - 1) * F.exp(z * k * k) for k in range(1, 11)), F.lit(0.0))
    return F.when(-z < 0.06, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms)))


def chi2_p_even(statistic: Column, df: int) -> Column:
    """Closed form for an even number of degrees: a Poisson sum."""
    half = statistic / 2
    return F.exp(-half) * sum((F.pow(half, F.lit(k)) / math.factorial(k) for k in range(df // 2)), F.lit(0.0))
