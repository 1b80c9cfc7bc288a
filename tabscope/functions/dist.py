"""Distribution tails without scipy: t, F and normal.

These run on aggregate rows only (one row per column, pair or group), as
Arrow-batched pandas UDFs, so their cost does not grow with the data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction 1 / (1 + d1 / (1 + d2 / ...)) of the incomplete beta function, from its end to its front.

    d(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m)) and d(2m+1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)). For x below
    its mean the number of terms needed grows with the root of the larger parameter.
    """
    value = 1.0
    for k in range(200 + int(8 * math.sqrt(max(a, b))), 0, -1):
        m, odd = divmod(k, 2)
        if odd:
            term = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + term * x / value
    return 1.0 / value


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or not df > 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    p = 0.5 * t_sf2(t, df)
    return 1.0 - p if t > 0 else p


def t_ppf(prob: float, df: float) -> float:
    """Quantile of Student's t by bisection on the CDF (aggregate rows only)."""
    if not (0.0 < prob < 1.0) or not (df > 0):
        return float("nan")
    if prob == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > prob:
        lo *= 2.0
    while t_cdf(hi, df) < prob:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < prob:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-12 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail P(F >= f) of the F distribution."""
    if f is None or math.isnan(f) or not (d1 > 0 and d2 > 0):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF."""
    return NormalDist().inv_cdf(p) if 0.0 < p < 1.0 else float("nan")


def _vec(fn, *series: pd.Series) -> pd.Series:
    vals = [fn(*(None if pd.isna(v) else float(v) for v in row)) if not any(pd.isna(v) for v in row) else None
            for row in zip(*series)]
    return pd.Series(vals, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_sf2, t, df)


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_ppf, p, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


def t_pvalue(t: Column, df: Column) -> Column:
    return t_pvalue_udf(t.cast("double"), df.cast("double"))


def t_quantile(p: Column, df: Column) -> Column:
    return t_quantile_udf(p.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return f_pvalue_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
