"""Two-sided p-values of a test statistic, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_MAX_TERMS = 300
_TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _MAX_TERMS):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) = I_x(df/2, 1/2) with x = df / (df + t²)."""
    t = np.abs(np.asarray(t, dtype=float))
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    a, x = df[ok] / 2.0, df[ok] / (df[ok] + t[ok] ** 2)
    y = t[ok] ** 2 / (df[ok] + t[ok] ** 2)
    gamma = np.fromiter((math.lgamma(v + 0.5) - math.lgamma(v) for v in a), float, len(a)) - math.lgamma(0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma + a * np.log(x) + 0.5 * np.log(y))
        lower = front * _beta_fraction(a, 0.5, x) / a
        upper = 1.0 - front * _beta_fraction(np.full_like(a, 0.5), a, y) / 0.5
    # The fraction converges fast below the mean of the beta distribution only.
    p = np.where(x < (a + 1.0) / (a + 2.5), lower, upper)
    out[ok] = np.where(t[ok] == 0, 1.0, np.clip(p, 0.0, 1.0))
    out[np.isinf(t)] = 0.0
    return out


def normal_p(z: np.ndarray) -> np.ndarray:
    z = np.abs(np.asarray(z, dtype=float))
    return np.fromiter((math.erfc(v / math.sqrt(2.0)) for v in z), float, len(z))


@F.pandas_udf(DoubleType())
def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    p = student_p(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p), None).astype("Float64")


@F.pandas_udf(DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    p = normal_p(z.to_numpy(float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p), None).astype("Float64")


def p_value(t: Column, df: Column | None = None) -> Column:
    """Two-sided p-value: Student t with `df` degrees of freedom, normal without."""
    return _normal(t) if df is None else _student(t, df.cast("double"))
