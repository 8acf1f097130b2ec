"""Tail probabilities without scipy: normal, Student's t, F."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d, tiny = 0.0, 1e-300
    for i in range(500):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    p = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return p if t >= 0 else 1 - p


def f_sf(f: float, a: float, b: float) -> float:
    return beta_cdf(b / (b + a * f), b / 2, a / 2) if f > 0 else 1.0


def normal_tail(z: Column) -> Column:
    """P(Z > z) as a column; for results of a few rows."""

    def tail(zs: pd.Series) -> pd.Series:
        return zs.map(lambda z: None if z is None or z != z else normal_sf(z)).astype("float64")

    return F.pandas_udf(tail, T.DoubleType())(z)
