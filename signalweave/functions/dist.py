"""t, F and normal distributions in numpy: incomplete beta by continued fraction, quantiles by bisection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(fn, values) -> np.ndarray:
    values = np.asarray(values, float)
    return np.array([fn(v) for v in values.ravel().tolist()]).reshape(values.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erf(x) -> np.ndarray:
    return _each(math.erf, x)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        p, q, y = a[inner], b[inner], x[inner]
        swap = y > (p + 1) / (p + q + 2)
        p, q, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - y, y)
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
        value = front * _fraction(p, q, y) / p
        out[inner] = np.where(swap, 1 - value, value)
    return out


def t_cdf(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def f_cdf(f, df1, df2) -> np.ndarray:
    f = np.asarray(f, float)
    return np.where(f <= 0, 0.0, beta_inc(np.asarray(df1) / 2, np.asarray(df2) / 2, df1 * np.maximum(f, 0) / (df1 * np.maximum(f, 0) + df2)))


def norm_cdf(z) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, float) / math.sqrt(2)))


def _quantile(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2
    while cdf(low) > p:
        low *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return _quantile(lambda x: float(t_cdf(x, df)), p, -1.0, 1.0)


def f_quantile(p: float, df1: float, df2: float) -> float:
    return _quantile(lambda x: float(f_cdf(x, df1, df2)), p, 0.0, 1.0)


def norm_quantile(p: float) -> float:
    return _quantile(lambda x: float(norm_cdf(x)), p, -1.0, 1.0)


def t_pvalue(t: Column, df: Column, alternative: str = "two.sided") -> Column:
    """p-value column of a t statistic."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        lower = t_cdf(t.to_numpy(float), df.to_numpy(float))
        found = {"less": lower, "greater": 1 - lower}.get(alternative, 2 * np.minimum(lower, 1 - lower))
        return pd.Series(found).where(np.isfinite(found))

    return p(t, df)


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of an F statistic."""

    @F.pandas_udf("double")
    def p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        found = 1 - f_cdf(f.to_numpy(float), a.to_numpy(float), b.to_numpy(float))
        return pd.Series(found).where(np.isfinite(found))

    return p(f, df1, df2)
