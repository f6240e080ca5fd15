"""Distribution functions, their tails and inverses as vectorised kernels and as columns.

Both tails are computed directly, never as one minus the other, so tails of 1e-100 keep their digits. An inverse solves for the logarithm of
the smaller tail by Newton's method within a bracket that each step narrows; a step that leaves the bracket is replaced by bisection.
Arguments outside a function's domain, and nulls, give null;
arguments beyond about 1e150, whose squares overflow, count as infinite.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_TINY = 1e-300


def log_gamma(a: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(a), float)


def _fraction(steps: Callable[[int], list[tuple[np.ndarray, np.ndarray]]], first: np.ndarray, most: int) -> np.ndarray:
    """Lentz's evaluation of first + n1 / (d1 + n2 / (d2 + ...)); ``steps(m)`` gives pairs (n, d)."""
    nonzero = lambda x: np.where(np.abs(x) < _TINY, _TINY, x)
    h = nonzero(np.asarray(first, float))
    c, d = h.copy(), np.zeros_like(h)
    for m in range(1, most):
        for num, den in steps(m):
            d = 1 / nonzero(den + num * d)
            c = nonzero(den + num / c)
            h = h * c * d
        if not (np.abs(c * d - 1) > 1e-15).any():
            break
    return h


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete gamma functions P(a, x) and Q(a, x): a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    with np.errstate(all="ignore"):
        good = (a > 0) & (x >= 0)
        p[good & (x == 0)], q[good & (x == 0)] = 0.0, 1.0
        p[good & np.isinf(x)], q[good & np.isinf(x)] = 1.0, 0.0
        good &= (x > 0) & np.isfinite(x)
        for low in (True, False):
            at = good & ((x < a + 1) == low)
            if not at.any():
                continue
            s, y = a[at], x[at]
            front = np.exp(s * np.log(y) - y - log_gamma(s))
            if low:
                term, total, k = 1 / s, 1 / s, 1
                while (term > 1e-17 * total).any() and k < 100_000:
                    term, k = term * y / (s + k), k + 1
                    total = total + term
                p[at] = front * total
                q[at] = 1 - p[at]
            else:
                q[at] = front / _fraction(lambda m: [(-m * (m - s), y + 2 * m + 1 - s)], y + 1 - s, 100_000)
                p[at] = 1 - q[at]
    return p, q


def beta_tails(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete beta function I_x(a, b) and its complement, for y = 1 - x given by itself."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, y)))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    with np.errstate(all="ignore"):
        good = (a > 0) & (b > 0) & (x >= 0) & (y >= 0)
        p[good & (x == 0)], q[good & (x == 0)] = 0.0, 1.0
        p[good & (y == 0)], q[good & (y == 0)] = 1.0, 0.0
        good &= (x > 0) & (y > 0)
        for low in (True, False):  # the fraction converges fast below the mean
            at = good & ((x < (a + 1) / (a + b + 2)) == low)
            if not at.any():
                continue
            s, t, u, v = (a[at], b[at], x[at], y[at]) if low else (b[at], a[at], y[at], x[at])
            front = np.exp(log_gamma(s + t) - log_gamma(s) - log_gamma(t) + s * np.log(u) + t * np.log(v)) / s
            one = np.ones_like(s)
            steps = lambda m: [(-(s + m - 1) * (s + t + m - 1) * u / ((s + 2 * m - 2) * (s + 2 * m - 1)), one), (m * (t - m) * u / ((s + 2 * m - 1) * (s + 2 * m)), one)]  # noqa: E731, B023
            part = front / _fraction(steps, one, 100_000)
            (p if low else q)[at] = part
            (q if low else p)[at] = 1 - part
    return p, q


def normal_tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.asarray(z, float)
    half = lambda v: 0.5 * np.asarray(_erfc(v / math.sqrt(2)), float)
    return half(-z), half(z)


def student_tails(t: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        r = t * t / df
        far = beta_tails(df / 2, np.full(t.shape, 0.5), 1 / (1 + r), r / (1 + r))[0] / 2
    return np.where(t > 0, 1 - far, far), np.where(t > 0, far, 1 - far)


def f_tails(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    with np.errstate(all="ignore"):
        return beta_tails(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2), d2 / (d1 * f + d2))


def chi2_tails(x: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gamma_tails(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def poisson_tails(k: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X > k)."""
    k = np.floor(np.asarray(k, float))
    p, q = gamma_tails(np.maximum(k, 0) + 1, mean)
    return np.where(k < 0, 0.0, q), np.where(k < 0, 1.0, p)


def _density(name: str, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of a distribution's density."""
    if name == "normal":
        return -x * x / 2 - math.log(2 * math.pi) / 2
    if name == "student":
        return log_gamma((a + 1) / 2) - log_gamma(a / 2) - 0.5 * np.log(a * math.pi) - (a + 1) / 2 * np.log1p(x * x / a)
    if name == "chi2":
        return (a / 2 - 1) * np.log(x) - x / 2 - a / 2 * math.log(2) - log_gamma(a / 2)
    return log_gamma((a + b) / 2) - log_gamma(a / 2) - log_gamma(b / 2) + a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b)


TAILS = {"normal": lambda x, a, b: normal_tails(x), "student": lambda x, a, b: student_tails(x, a), "chi2": lambda x, a, b: chi2_tails(x, a), "f": f_tails}


def quantile(name: str, p: np.ndarray, a: np.ndarray | float = 1.0, b: np.ndarray | float = 1.0, upper: bool = False) -> np.ndarray:
    """x with P(X <= x) = p, or P(X > x) = p for ``upper``, of a normal, student (a degrees of freedom), chi2 (a) or f (a, b) distribution."""
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    two_sided = name in ("normal", "student")
    out = np.full(p.shape, np.nan)
    ok = (p > 0) & (p < 1) & (a > 0) & (b > 0)
    ends = ((-np.inf, np.inf) if two_sided else (0.0, np.inf))
    out[(p == 0) & (a > 0) & (b > 0)], out[(p == 1) & (a > 0) & (b > 0)] = ends[::-1] if upper else ends
    if not ok.any():
        return out
    q, a, b = p[ok], a[ok], b[ok]
    which = np.where(q <= 0.5, int(upper), 1 - int(upper))  # the smaller tail, solved for by its logarithm
    target = np.log(np.where(q <= 0.5, q, 1 - q))
    tail = lambda x: np.where(which == 0, *TAILS[name](x, a, b))
    with np.errstate(all="ignore"):
        # in y, the logarithm of x where x is positive; the tail falls from low to high (which = 1) or rises (which = 0)
        at = (lambda y: y) if two_sided else np.exp
        excess = lambda y: np.where(which == 1, 1, -1) * (np.log(tail(at(y))) - target)  # positive: the root is above
        low, high = np.full(q.shape, -1.0), np.full(q.shape, 1.0)
        for _ in range(700 if not two_sided else 1100):
            more = excess(high) > 0
            less = ~(excess(low) > 0)
            if not (more | less).any():
                break
            span = high - low
            high, low = np.where(more, high + span, high), np.where(less, low - span, low)
        y = (low + high) / 2
        for _ in range(200):
            e, x = excess(y), at(y)
            low, high = np.where(e > 0, y, low), np.where(e > 0, high, y)
            slope = np.exp(_density(name, x, a, b) - np.log(tail(x))) * (1 if two_sided else x)
            after = y + e / slope
            after = np.where((after > low) & (after < high), after, (low + high) / 2)
            done = np.abs(after - y) <= 4e-16 * np.abs(y)
            y = after
            if done.all():
                break
        out[ok] = at(y)
    return out


def _column(kernel: Callable[..., np.ndarray], *args: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(kernel(*(v.to_numpy(float) for v in (a, b, c)))).astype("float64")

    one = F.lit(1.0)
    value = run(*[x.cast("double") for x in [*args, one, one][:3]])
    return F.when(~F.isnan(value), value)


def cdf(name: str, x: Column, *parameters: Column) -> Column:
    """P(X <= x); name as in :func:`quantile`, or poisson (mean)."""
    return _column((lambda k, m, _: poisson_tails(k, m)[0]) if name == "poisson" else lambda x, a, b: TAILS[name](x, a, b)[0], x, *parameters)


def sf(name: str, x: Column, *parameters: Column) -> Column:
    """P(X > x)."""
    return _column((lambda k, m, _: poisson_tails(k, m)[1]) if name == "poisson" else lambda x, a, b: TAILS[name](x, a, b)[1], x, *parameters)


def critical(name: str, p: Column, *parameters: Column, upper: bool = False) -> Column:
    return _column(lambda p, a, b: quantile(name, p, a, b, upper), p, *parameters)
