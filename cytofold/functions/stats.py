"""Distribution tails and special functions in numpy, and multiple-testing corrections as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive x: Stirling's series after a shift to 10 or more."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift = np.where(low, shift + np.log(x), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + stirling(x) - shift


def stirling(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves out of log gamma of x >= 10."""
    z = 1 / (x * x)
    return (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x


def digamma_rest(x: np.ndarray) -> np.ndarray:
    """digamma(x) - log(x) of x >= 10."""
    z = 1 / (x * x)
    return -0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    return out + np.log(x) + digamma_rest(x)


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 15).any():
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (lgamma(p) + lgamma(q) - lgamma(p + q))) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for k, num in ((0, m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))), (1, -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
            break
    got = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - got, got)


def gammaincc(a, x) -> np.ndarray:
    """The upper regularised incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    small = (x > 0) & (x < a + 1)
    if small.any():
        s, y = a[small], x[small]
        term, total, k = 1 / s, 1 / s, s.copy()
        for _ in range(2000):
            k = k + 1
            term = term * y / k
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[small] = 1 - total * np.exp(-y + s * np.log(y) - lgamma(s))
    large = x >= a + 1
    if large.any():
        s, y = a[large], x[large]
        b = y + 1 - s
        c, d = np.full_like(y, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[large] = h * np.exp(-y + s * np.log(y) - lgamma(s))
    return out


def chi2_sf(x, df) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.maximum(np.asarray(x, float), 0) / 2)


def normal_pvalues(z: np.ndarray) -> np.ndarray:
    """Two-sided; not a number where z isn't finite."""
    z = np.asarray(z, dtype=float)
    out = np.full(z.shape, np.nan)
    fine = np.isfinite(z)
    from math import erfc, sqrt

    out[fine] = [min(1.0, erfc(abs(v) / sqrt(2))) for v in z[fine]]
    return out


def t_pvalues(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided; not a number where t or df isn't finite."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    fine = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out[fine] = np.minimum(1.0, betainc(df[fine] / 2, 0.5, df[fine] / (df[fine] + t[fine] ** 2)))
    return out


def f_quantile(p: float, d1: float, d2: float) -> float:
    """By bisection on x = d1 f / (d1 f + d2)."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if betainc(d1 / 2, d2 / 2, mid) < p else (lo, mid)
    x = (lo + hi) / 2
    return float(d2 * x / (d1 * (1 - x)))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_pvalues(z.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_pvalues(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def bh(df: DataFrame, p: str = "pvals", into: str = "pvals_adj", by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg within `by`. Null p-values get null and don't count; to count them, make them 1 first."""
    keys = [F.col(b) for b in by] or [F.lit(0)]
    some = F.col(p).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys, some).orderBy(F.col(p), *order))
    n = F.count(F.when(some, 1)).over(Window.partitionBy(*keys))
    out = df.withColumn("_r", rank).withColumn("_q", F.when(some, F.col(p) * n / F.col("_r")))
    least = F.min("_q").over(Window.partitionBy(*keys, some).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(into, F.when(some, F.least(F.lit(1.0), least))).drop("_r", "_q")


def bh_array(p: np.ndarray) -> np.ndarray:
    """The same on the driver."""
    p = np.asarray(p, dtype=float)
    out, fine = np.full(len(p), np.nan), np.nonzero(~np.isnan(p))[0]
    order = fine[np.argsort(-p[fine], kind="stable")]
    m = len(order)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * m / np.arange(m, 0, -1)))
    return out
