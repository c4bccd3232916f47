"""Special functions and distributions for scalars and numpy arrays, and pandas UDFs over them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_left(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    return 1 - front * _lentz(lambda i: (x + 1 - a if i == 0 else x + 2 * i + 1 - a, 1.0 if i == 0 else -i * (i - a)))


def _lentz(step, limit: int = 5000) -> float:
    """A continued fraction a1/(b0 + a2/(b1 + ...)); step(i) gives (b_i, a_{i+1})."""
    tiny = 1e-300
    f, c, d = tiny, tiny, 0.0
    for i in range(limit):
        b, a = step(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_left(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_left(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def step(i: int) -> tuple[float, float]:
        if i == 0:
            return 1.0, 1.0
        m, odd = divmod(i, 2)
        if odd:
            return 1.0, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1.0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return front * _lentz(step) / a


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_left(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def f_right(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_left(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_right(x: float, df: float) -> float:
    return 1 - gamma_left(df / 2, x / 2)


def binomial_cdf(k: float, n: float, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else 1 - beta_left(k + 1, n - k, p)


def poisson_cdf(k: float, mean: float) -> float:
    return 0.0 if k < 0 else 1 - gamma_left(k + 1, mean)


def _inverse(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        low, high = high, high * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return -t_quantile(1 - p, df) if p < 0.5 else _inverse(lambda x: t_cdf(x, df), p, 0.0, 2.0)


def chi2_quantile(p: float, df: float) -> float:
    return _inverse(lambda x: gamma_left(df / 2, x / 2), p, 0.0, df + 10)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _inverse(lambda x: 1 - f_right(x, d1, d2), p, 0.0, 4.0)


def beta_quantile(p: float, a: float, b: float) -> float:
    return _inverse(lambda x: beta_left(a, b, x), p, 0.0, 1.0)


def noncentral_t_cdf(t: float, df: float, delta: float) -> float:
    """By Gauss-Legendre quadrature over the scaled chi distribution."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    spread = 12 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    s = 0.5 * (high - low) * nodes + 0.5 * (high + low)
    log_pdf = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.array([normal_cdf(t * x - delta) for x in s])
    return float(min(1.0, max(0.0, 0.5 * (high - low) * np.sum(weights * np.exp(log_pdf) * inner))))


def noncentral_f_cdf(f: float, d1: float, d2: float, lam: float) -> float:
    """A Poisson mixture of central distributions."""
    x, total, j = d1 * f / (d1 * f + d2), 0.0, 0
    weight = math.exp(-lam / 2)
    seen = 0.0
    while seen < 1 - 1e-13 and j < 10000:
        total += weight * beta_left(d1 / 2 + j, d2 / 2, x)
        seen += weight
        j += 1
        weight *= lam / 2 / j
    return total


def _udf(function):
    """A pandas UDF of doubles over a scalar function; null in, null out."""

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(v is None or v != v for v in r) else function(*map(float, r)) for r in rows], dtype="float64")

    return lambda *columns: run(*[c if not isinstance(c, (int, float)) else F.lit(float(c)) for c in columns])


def log_normal_cdf(z: float) -> float:
    """Logarithm of the normal distribution function; far below by its asymptotic series, so it never is minus infinity."""
    if z > -30:
        return math.log(normal_cdf(z)) if z < 0 else math.log1p(-normal_cdf(-z))
    return -z * z / 2 - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / z**2 + 3 / z**4)


log_normal_cdf_col = _udf(log_normal_cdf)
normal_cdf_col, normal_quantile_col = _udf(normal_cdf), _udf(normal_quantile)
t_cdf_col, t_quantile_col, f_right_col = _udf(t_cdf), _udf(t_quantile), _udf(f_right)
chi2_right_col, chi2_quantile_col = _udf(chi2_right), _udf(chi2_quantile)
beta_quantile_col, binomial_cdf_col, poisson_cdf_col = _udf(beta_quantile), _udf(binomial_cdf), _udf(poisson_cdf)
