"""Statistical expressions and quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Guard against the logarithm of zero in likelihoods.
GUARD = 1e-10


def z_value(confidence: float = 0.95) -> float:
    """Two-sided quantile of the normal distribution."""
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def chi2_value(confidence: float = 0.95) -> float:
    """Quantile of the chi-squared distribution with one degree of freedom."""
    return z_value(confidence) ** 2


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(x: Column) -> Column:
    """``x`` with NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def wilson(p: Column, n: Column, confidence: float = 0.95, model_error: float | None = None, least_error: float = 0.001) -> tuple[Column, Column]:
    """Wilson bounds of a share ``p`` of ``n``, within [0, 1]; (0, 1) for n = 0.

    With ``model_error``, the half-width is widened by an error that falls with the root of n from that value at
    a thousand rows to ``least_error``.
    """
    z = z_value(confidence)
    n = n.cast("double")
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    if model_error is not None:
        extra = F.greatest(F.lit(least_error), model_error / F.sqrt(n / 1000))
        half = F.sqrt(half * half + (z * extra) * (z * extra))
    none = n == 0
    return F.when(none, 0.0).otherwise(clip(middle - half)), F.when(none, 1.0).otherwise(clip(middle + half))


def logit_interval(alpha: Column, information: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of ``alpha`` from its Fisher information on the logit scale; plain ones within a thousandth of 0 or 1, and
    (0, 1) where the information is next to nothing."""
    z = z_value(confidence)
    se = 1 / F.sqrt(information)
    middle, width = F.log(alpha / (1 - alpha)), z * se / (alpha * (1 - alpha))
    sigmoid = lambda x: F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    inner, none = (alpha > 0.001) & (alpha < 0.999), information <= 1e-10
    lower = F.when(none, 0.0).when(inner, sigmoid(middle - width)).otherwise(clip(alpha - z * se))
    upper = F.when(none, 1.0).when(inner, sigmoid(middle + width)).otherwise(clip(alpha + z * se))
    return lower, upper


def wald_interval(alpha: Column, information: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of ``alpha`` at a multiple of its standard error, within [0, 1]; (0, 1) without information."""
    margin, none = z_value(confidence) / F.sqrt(information), information <= 1e-10
    return F.when(none, 0.0).otherwise(clip(alpha - margin)), F.when(none, 1.0).otherwise(clip(alpha + margin))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1)) if 1 - (a + b) * x / (a + 1) > 0 else 1 / tiny
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Probability that a t variable exceeds ``t`` in absolute value."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_value(df: float, confidence: float = 0.95) -> float:
    """Two-sided quantile of the t distribution."""
    if df > 1e7:
        return z_value(confidence)
    lo, hi = 0.0, 1.0
    while t_tail(hi, df) > 1 - confidence:
        hi *= 2
    for _ in range(200):
        middle = (lo + hi) / 2
        if t_tail(middle, df) > 1 - confidence:
            lo = middle
        else:
            hi = middle
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_quantile(df: pd.Series, confidence: pd.Series) -> pd.Series:
    known = {k: t_value(*k) for k in {(float(d), float(c)) for d, c in zip(df, confidence, strict=True) if d == d and d > 0}}
    return pd.Series([known.get((float(d), float(c)), np.nan) for d, c in zip(df, confidence, strict=True)])


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(float(x), float(d)) if x == x and d == d and d > 0 else np.nan for x, d in zip(t, df, strict=True)])
