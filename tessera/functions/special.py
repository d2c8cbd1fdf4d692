"""Special functions and tails of distributions, as scalars and vectorised column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d, tiny = 0.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi2_tail(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def normal_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def _vector(fn, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series, strict=True)], dtype="float64")

    return apply(*columns)


def erf(x: Column) -> Column:
    return _vector(math.erf, x)


def erfc(x: Column) -> Column:
    return _vector(math.erfc, x)


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal variable lies with probability p."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return _vector(lambda x: inverse(min(max(x, 1e-300), 1 - 1e-16)), p)


def gammln(x: Column) -> Column:
    return _vector(math.lgamma, x)


def chisqprob(x: Column, df: Column) -> Column:
    return _vector(chi2_tail, x, df)


def zprob(z: Column) -> Column:
    return _vector(normal_cdf, z)


def fprob(f: Column, df1: Column, df2: Column) -> Column:
    return _vector(f_tail, f, df1, df2)


def tprob(t: Column, df: Column) -> Column:
    return _vector(t_two_sided, t, df)


def log_binomial(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def stirling2(n: int, k: int) -> int:
    return sum((-1) ** i * math.comb(k, i) * (k - i) ** n for i in range(k + 1)) // math.factorial(k)


def bell(n: int) -> int:
    return sum(stirling2(n, k) for k in range(n + 1))
