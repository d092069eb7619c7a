"""Distribution functions that Spark SQL lacks, over arrays: Student's t by the incomplete beta function, and the normal distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz), on the side where it converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(np.maximum(y, tiny)) + q * np.log(np.maximum(1 - y, tiny))) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, rounds):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
    value = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def t_quantile(share: float, df: np.ndarray) -> np.ndarray:
    """t with P(|T| <= t) = share, by bisection."""
    low, high = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(120):
        mid = (low + high) / 2
        inside = 1 - t_two_sided(mid, df) < share
        low, high = np.where(inside, mid, low), np.where(inside, high, mid)
    return (low + high) / 2


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def _safe(f, *series: pd.Series) -> pd.Series:
    ok = np.logical_and.reduce([s.notna().to_numpy() for s in series])
    out = np.full(len(series[0]), np.nan)
    if ok.any():
        out[ok] = f(*[s.to_numpy(float)[ok] for s in series])
    return pd.Series(out).astype(object).where(pd.Series(ok), None)


@pandas_udf(DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _safe(t_two_sided, t, df)


@pandas_udf(DoubleType())
def _t_95(df: pd.Series) -> pd.Series:
    return _safe(lambda d: t_quantile(0.95, d), df)


@pandas_udf(DoubleType())
def _normal(x: pd.Series) -> pd.Series:
    return _safe(normal_cdf, x)


def p_value(t: Column, df: Column) -> Column:
    return _p_value(t, df)


def t_95(df: Column) -> Column:
    return _t_95(df)


def phi(x: Column) -> Column:
    return _normal(x)
