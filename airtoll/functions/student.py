"""Two-sided Student t tail and quantile for small result tables (vectorised numpy)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_975 = 1.959963984540054


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log(gamma(a + 1/2) / gamma(a)) without the cancellation of two large logarithms."""
    shift = np.maximum(np.ceil(30 - a), 0)
    big = a + shift
    series = 0.5 * np.log(big) - 1 / (8 * big) + 1 / (192 * big**3) - 1 / (640 * big**5) + 17 / (14336 * big**7)
    # gamma(a + 1/2) / gamma(a) = gamma(a + 3/2) / gamma(a + 1) * a / (a + 1/2)
    for i in range(int(shift.max(initial=0))):
        series += np.where(i < shift, np.log((a + i) / (a + i + 0.5)), 0.0)
    return series


def _incomplete_beta(a: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, 1/2) by its continued fraction (modified Lentz); rest is 1 - x."""
    b = 0.5
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.where(flip, rest, x)
    with np.errstate(divide="ignore"):
        log_x = np.where(x > 0.5, np.log1p(-rest), np.log(x))
        front = np.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * log_x + b * np.log(rest)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    else:
        h = np.where(np.abs(d * c - 1) < 1e-12, h, np.nan)  # not converged: no value rather than a wrong one
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


LARGE_DF = 1e4


def _near_normal(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail for many degrees of freedom: t is turned into a normal deviate (Hill 1970, algorithm 395)."""
    a = df - 0.5
    b = 48 * a * a
    y = a * np.log1p(t * t / df)
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * np.sqrt(y)
    return np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2))


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); nan where t or df is missing or df < 1."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    known = ~np.isnan(t) & ~np.isnan(df) & (df >= 1)
    out = np.full(t.shape, np.nan)
    tt, dd = t[known], df[known]
    many = dd > LARGE_DF
    p = np.empty(tt.shape)
    with np.errstate(over="ignore", invalid="ignore"):
        if many.any():
            p[many] = np.where(np.isinf(tt[many]), 0.0, _near_normal(np.where(np.isinf(tt[many]), 0.0, tt[many]), dd[many]))
        if not many.all():
            few, square = dd[~many], tt[~many] ** 2
            rest = np.where(np.isinf(square), 1.0, square / (few + square))
            p[~many] = _incomplete_beta(few / 2, few / (few + square), rest)
    out[known] = p
    return out


def t_quantile_975(df: np.ndarray) -> np.ndarray:
    """97.5 % quantile by bisection on the tail."""
    df = np.asarray(df, float)
    low, high = np.full(df.shape, 1.9), np.full(df.shape, 13.0)
    for _ in range(60):
        mid = (low + high) / 2
        above = two_sided_p(mid, df) > 0.05
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.where(df >= 1, (low + high) / 2, np.nan)


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value column; applied to result tables, never to facts."""

    @F.pandas_udf("double")
    def tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(statistic.to_numpy(float), freedom.to_numpy(float)))

    return F.nanvl(tail(t, df.cast("double")), F.lit(None).cast("double"))


def half_width_factor(df: Column, interval: str) -> Column:
    """Multiplier of the standard error in a 95 % interval."""
    if interval == "normal":
        return F.lit(NORMAL_975)
    if interval != "t":
        raise ValueError("interval must be 'normal' or 't'")

    @F.pandas_udf("double")
    def quantile(freedom: pd.Series) -> pd.Series:
        return pd.Series(t_quantile_975(freedom.to_numpy(float)))

    return F.nanvl(quantile(df.cast("double")), F.lit(None).cast("double"))
