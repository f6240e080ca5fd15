"""Tails and inverses against exact sums, closed forms and numerical integration in high precision."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmer.functions import distributions as D

getcontext().prec = 60


def even_chi2(x, df):
    """Upper tail for even degrees of freedom: a finite sum."""
    y, term, total = Decimal(x) / 2, Decimal(1), Decimal(0)
    for j in range(df // 2):
        total += term
        term = term * y / (j + 1)
    return float((-y).exp() * total)


def integrated(f, a, b, n=20_000):
    h = (b - a) / n
    return h / 3 * math.fsum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


@pytest.mark.parametrize("df", [2, 4, 10, 40, 200])
def test_chi_square_and_poisson_tails(df):
    for x in (0.01, 0.5, 3.0, 17.0, 60.0, 200.0, 900.0):
        low, high = D.chi2_tails(x, df)
        assert math.isclose(high, even_chi2(x, df), rel_tol=1e-11)
        assert math.isclose(low + high, 1, rel_tol=1e-14)
        k = df // 2 - 1
        assert math.isclose(D.poisson_tails(k, x / 2)[0], even_chi2(x, df), rel_tol=1e-11)
    far = float(D.poisson_tails(60, 2.0)[1])
    exact = float(sum(Decimal(2) ** i / math.factorial(i) for i in range(61, 160)) * Decimal(-2).exp())
    assert far < 1e-60 and math.isclose(far, exact, rel_tol=1e-11)
    assert D.poisson_tails(-1, 3.0)[0] == 0 and D.poisson_tails(-1, 3.0)[1] == 1


def test_student_and_f_tails():
    for df in (1.0, 2.0, 5.5, 18.0, 300.0):
        front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (0.1, 1.0, 2.5):
            want = 0.5 + integrated(lambda s: front * (1 + s * s / df) ** (-(df + 1) / 2), 0, t)
            assert math.isclose(D.student_tails(t, df)[0], want, rel_tol=1e-10) and math.isclose(D.student_tails(-t, df)[1], want, rel_tol=1e-10)
    assert math.isclose(D.student_tails(-1e9, 2.0)[0], 1 / (2 * 1e18), rel_tol=1e-6) and math.isclose(D.student_tails(1e12, 1.0)[1], 1 / (math.pi * 1e12), rel_tol=1e-9)
    for d2 in (1.0, 3.0, 44.0):
        for f in (0.2, 1.0, 9.0, 1e4):
            assert math.isclose(D.f_tails(f, 2.0, d2)[1], (1 + 2 * f / d2) ** (-d2 / 2), rel_tol=1e-11)
    assert math.isclose(D.normal_tails(-12.0)[0], 1.7764821120776e-33, rel_tol=1e-9)


def test_inverses_return_to_their_tails():
    some = np.array([1e-200, 1e-40, 1e-12, 1e-3, 0.05, 0.3, 0.5, 0.7, 0.95, 0.9999])
    for upper in (False, True):
        for name, tails, sets in (("normal", lambda x, a, b: D.normal_tails(x), [(1, 1)]), ("student", lambda x, a, b: D.student_tails(x, a), [(1, 1), (2, 1), (7.5, 1), (200, 1)]), ("chi2", lambda x, a, b: D.chi2_tails(x, a), [(1, 1), (2, 1), (19, 1), (500, 1)]), ("f", D.f_tails, [(1, 1), (2, 9), (30, 4), (60, 80)])):
            for a, b in sets:
                p = some[1:] if name != "normal" and min(a, b if name == "f" else a) < 3 else some  # else beyond the range of doubles
                x = D.quantile(name, p, a, b, upper)
                back = tails(x, np.full(p.shape, float(a)), np.full(p.shape, float(b)))[int(upper)]
                assert np.allclose(back, p, rtol=1e-9, atol=0), (name, a, b, upper, x, back)
                assert (np.diff(x) < 0).all() if upper else (np.diff(x) > 0).all()
    assert math.isclose(D.quantile("normal", 0.975), 1.959963984540054, rel_tol=1e-13)
    assert np.isnan(D.quantile("chi2", [-0.1, 1.1, 0.5], [1, 1, -1])).all() and D.quantile("f", 0.0, 3, 4) == 0 and np.isinf(D.quantile("student", 1.0, 3))


def test_columns(spark):
    df = spark.createDataFrame([(0.2, 4.0, 6.0), (None, 4.0, 6.0), (float("nan"), 4.0, 6.0), (1.5, 4.0, 6.0)], "p double, a double, b double")
    c = [F.col(x) for x in "pab"]
    got = df.select(D.critical("f", *c).alias("q"), D.cdf("f", *c).alias("c"), D.sf("poisson", F.col("a"), F.col("b")).alias("s"), D.critical("chi2", F.col("p"), F.col("a"), upper=True).alias("u")).collect()
    assert math.isclose(got[0].q, float(D.quantile("f", 0.2, 4.0, 6.0))) and math.isclose(got[0].u, float(D.quantile("chi2", 0.2, 4.0, upper=True)))
    assert math.isclose(got[0].s, float(D.poisson_tails(4.0, 6.0)[1])) and got[1].q is None and got[2].q is None and got[3].q is None and got[3].c > 0
