"""Tail probabilities of the tests on column pairs, inside small pandas UDFs: one row per pair."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOSE = 1e-14
_TINY = 1e-300

def _steps(size: float) -> int:
    """Enough steps for a continued fraction, which converges after about the square root of its parameters."""
    return 500 + int(10 * math.sqrt(size))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / _away(1.0 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, _steps(max(a, b))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / _away(1.0 + even * d), _away(1.0 + even / c)
        total *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / _away(1.0 + odd * d), _away(1.0 + odd / c)
        total *= d * c
        if abs(d * c - 1.0) < _CLOSE:
            break
    return front * total / a


def _away(value: float) -> float:
    return value if abs(value) > _TINY else _TINY


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for i in range(1, _steps(a + x)):
        step = -i * (i - a)
        b += 2
        d, c = 1.0 / _away(step * d + b), _away(b + step / c)
        total *= d * c
        if abs(d * c - 1.0) < _CLOSE:
            break
    return front * total


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson correlation over n rows."""
    if abs(r) >= 1.0:
        return 0.0
    free = n - 2
    if free <= 0:
        return float("nan")
    t2 = r * r * free / (1.0 - r * r)
    return beta_tail(free / 2, 0.5, free / (free + t2))


@F.pandas_udf(T.DoubleType())
def association_p_udf(value: pd.Series, size: pd.Series, free: pd.Series) -> pd.Series:
    """Of a correlation ``value`` over ``size`` rows, or, with degrees of freedom, of a chi-squared of that size."""
    tails = [correlation_p(v, n) if f != f else gamma_tail(f / 2, n / 2) for v, n, f in zip(value, size, free)]
    return pd.Series(tails, dtype=float)
