"""Student's t distribution for result rows: two-sided p values and quantiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def beta_fraction(a: np.ndarray, b: float | np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta function, by the modified Lentz rule."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    out = d.copy()
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
            d = 1 / d
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return out


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b): the fraction where it converges fast, else 1 - I_(1-x)(b, a)."""
    x = np.clip(x, 0.0, 1.0)
    front = np.array([math.exp(math.lgamma(p + b) - math.lgamma(p) - math.lgamma(b) + (p * math.log(v) if v else -math.inf) + (b * math.log1p(-v) if v < 1 else -math.inf)) for p, v in zip(a, x)])
    low = x < (a + 1) / (a + b + 2)
    here = front * beta_fraction(a, b, np.where(low, x, 0.0)) / a
    there = 1 - front * beta_fraction(np.full_like(a, b), a, np.where(low, 0.0, 1 - x)) / b
    return np.where(low, here, there)


def p_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|); NaN where t or df isn't a number or df is below 1."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if ok.any():
        n, v = df[ok], t[ok]
        out[ok] = incomplete_beta(n / 2, 0.5, n / (n + v * v))
    return out


def two_sided_quantile(level: float, df: np.ndarray) -> np.ndarray:
    """The t that |T| exceeds with probability 1 - ``level``, by bisection; NaN where df is below 1."""
    df = np.asarray(df, float)
    out = np.full(df.shape, np.nan)
    ok = df > 0
    if ok.any():
        n = df[ok]
        low, high = np.zeros(len(n)), np.ones(len(n))
        while (wide := p_two_sided(high, n) > 1 - level).any():
            high = np.where(wide, 2 * high, high)
        for _ in range(200):
            middle = (low + high) / 2
            above = p_two_sided(middle, n) > 1 - level
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        out[ok] = (low + high) / 2
    return out


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(p_two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def _critical(df: pd.Series) -> pd.Series:
    return pd.Series(two_sided_quantile(0.95, df.to_numpy(float, na_value=np.nan)))


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic, null where there is none. For result rows: it runs in Python."""
    return F.nanvl(_p_value(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def critical(df: Column) -> Column:
    """The 97.5 % quantile, half the width of a 95 % interval in standard errors; null without degrees of freedom."""
    return F.nanvl(_critical(df.cast("double")), F.lit(None).cast("double"))
