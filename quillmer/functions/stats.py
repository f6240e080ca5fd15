"""Two-sample and one-sample statistics as column expressions over sums; distribution functions.

Closed forms stay in the JVM: the Student distribution for whole degrees of freedom, the normal distribution. The
incomplete beta function (F, Welch) is a vectorised pandas function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def student_cdf(t: Column, df: int) -> Column:
    """P(T <= t) for ``df`` >= 1 degrees of freedom: the finite trigonometric series (odd and even forms)."""
    if df < 1:
        raise ValueError("degrees of freedom must be positive")
    return F.transform(F.array(t), lambda x: _series(x, df))[0]


def _series(t: Column, df: int) -> Column:
    c2 = F.lit(float(df)) / (F.lit(float(df)) + t * t)
    theta = F.atan(t / math.sqrt(df))
    series = F.lit(1.0)
    if df == 1:
        return 0.5 + theta / math.pi
    for j in range(df - 2, 1 + df % 2, -2):
        series = 1.0 + F.lit((j - 1) / j) * c2 * series
    if df % 2 == 0:
        return 0.5 + 0.5 * F.sin(theta) * series
    return 0.5 + (theta + F.sin(theta) * F.cos(theta) * series) / math.pi


def pooled_t(n1: int, m1: Column, v1: Column, n2: int, m2: Column, v2: Column) -> Column:
    """Student's t with pooled variance; null where both variances are 0."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return (m1 - m2) / F.nullif(F.sqrt(pooled * (1.0 / n1 + 1.0 / n2)), F.lit(0.0))


def tails(t: Column, df: int, m1: Column, m2: Column) -> tuple[Column, Column, Column]:
    """(both, left, right). Left is small where the first mean is below. Without variance the means alone decide."""
    cdf = student_cdf(t, df)
    left = F.when(t.isNull(), F.when(m1 < m2, 0.0).otherwise(1.0)).otherwise(cdf)
    right = F.when(t.isNull(), F.when(m1 > m2, 0.0).otherwise(1.0)).otherwise(1.0 - cdf)
    both = F.when(t.isNull(), F.when(m1 == m2, 1.0).otherwise(0.0)).otherwise(2 * F.least(cdf, 1.0 - cdf))
    return both, left, right


def welch(n1: int, m1: Column, v1: Column, n2: int, m2: Column, v2: Column) -> tuple[Column, Column]:
    """Unpooled t and its degrees of freedom (Welch-Satterthwaite)."""
    a, b = v1 / n1, v2 / n2
    return (m1 - m2) / F.nullif(F.sqrt(a + b), F.lit(0.0)), (a + b) * (a + b) / F.nullif(a * a / (n1 - 1) + b * b / (n2 - 1), F.lit(0.0))


def corr_t(r: Column, n: Column) -> Column:
    """t of a correlation of ``n`` pairs, with n - 2 degrees of freedom; null for a perfect one."""
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if not (a > 0 and b > 0) or x != x:
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def incomplete_beta_column(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([incomplete_beta(*v) for v in zip(a, b, x)], dtype="float64")


def f_cdf(f: Column, d1: Column, d2: Column) -> Column:
    return incomplete_beta_column(d1 / 2.0, d2 / 2.0, d1 * f / (d1 * f + d2))


def student_cdf_real(t: Column, df: Column) -> Column:
    """P(T <= t) for any positive degrees of freedom."""
    half = incomplete_beta_column(df / 2.0, F.lit(0.5), df / (df + t * t)) / 2.0
    return F.when(t < 0, half).otherwise(1.0 - half)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else np.nan for v in z], dtype="float64")


def binomial_tail(k: int, n: int) -> float:
    """P(X <= k) for n fair coins."""
    return sum(math.comb(n, i) for i in range(k + 1)) / 2.0**n


def binomial_cdf(k: Column, n: Column) -> Column:
    """P(X <= k) for n fair coins: 0 below none, 1 from all on."""
    tail = incomplete_beta_column((n - k).cast("double"), (k + 1).cast("double"), F.lit(0.5))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(tail)


def two_sided(cdf: Column) -> Column:
    """p of both tails of a continuous distribution."""
    return 2 * F.least(cdf, 1 - cdf)
