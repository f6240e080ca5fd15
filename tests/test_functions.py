"""Sequence, vector and statistics functions against hand-made values and plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmer.functions import seq, stats, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_strings(spark):
    s = F.lit
    assert one(spark, seq.revcomp(s("AACGT")), seq.canonical(s("ACGTT")), seq.canonical(s("ACGT")), seq.revcomp(s(None).cast("string"))) == ("ACGTT", "AACGT", "ACGT", None)
    assert one(spark, seq.encode(s("AACGT")), seq.decode(F.lit(27).cast("long"), 5), seq.encode(s("ACNGT")), seq.encode(s("T" * 31))) == (27, "AACGT", seq_number("ACAGT"), 4**31 - 1)
    p = F.lit(seq_number("ACGTA")).cast("long")
    assert one(spark, seq.decode(seq.roll_forward(p, F.lit(2), 5), 5), seq.decode(seq.roll_backward(p, F.lit(3), 5), 5), seq.base_at(p, 3, 5)) == ("CGTAG", "TACGT", 3)
    assert one(spark, F.transform(seq.links(p, 5), lambda x: seq.decode(x, 5)))[0] == ["CGTAA", "CGTAC", "CGTAG", "CGTAT", "AACGT", "CACGT", "GACGT", "TACGT"]
    assert one(spark, seq.kmers(s("ACGTA"), 3), seq.kmers(s("AC"), 3), seq.clean(s("acNg-T"), "skip"), seq.clean(s("acNgT"))) == (["ACG", "CGT", "GTA"], [], "ACNGNT", "AAAAT")


def seq_number(s):
    n = 0
    for c in s:
        n = n * 4 + "ACGT".index(c)
    return n


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNacgt", max_size=60), st.integers(1, 31), st.sampled_from(["skip", "as_a"]))
def test_windows_equal_strings(s, k, invalid):
    kmer, ok = seq.pack_windows(s.encode(), k, invalid)
    assert len(kmer) == max(0, len(s) - k + 1)
    for i in range(len(kmer)):
        w = s[i : i + k]
        w = w.upper() if invalid == "skip" else "".join(c if c in "ACGT" else "A" for c in w)
        assert ok[i] == ("N" not in w)
        if ok[i]:
            assert kmer[i] == min(seq_number(w), seq_number(revcomp(w)))


def test_signature_rules(spark):
    def value(m):
        poor = m.endswith("TGT") or m[-3:-1] == "TT" or m.startswith("ACA") or "AA" in m[1:]
        return 4 ** len(m) if poor else seq_number(m)

    rng = np.random.default_rng(3)
    kmers = ["".join(rng.choice(list("ACGT"), 9)) for _ in range(200)] + ["A" * 9, "T" * 9]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in kmers], "k string").select("k", seq.signature(5, F.col("k")).alias("s")).collect()}
    for k in kmers:
        assert got[k] == min(min(value(k[i : i + 5]), value(revcomp(k[i : i + 5]))) for i in range(5))


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    got = one(spark, vectors.cosine_distance(a, b), vectors.euclidean(a, b), vectors.cosine_distance(a, zero), vectors.l2_normalise(a), vectors.l2_normalise(zero))
    assert got[0] == pytest.approx(0.04) and got[1] == pytest.approx(math.sqrt(2)) and got[2] is None and got[3] == [0.6, 0.8] and got[4] == [0.0, 0.0]
    e = np.array([[1.0, 0.0], [-1.0, 0.0]])
    assert one(spark, vectors.srp_key(F.array(F.lit(0.0), F.lit(5.0)), e))[0] == 3  # a dot of 0 is bit 1
    assert one(spark, vectors.pstable_key(F.array(F.lit(1.0), F.lit(2.0)), e, 0.5, 0.4))[0] == "3-1"  # towards zero
    assert (vectors.planes(3, 4, 9) == vectors.planes(3, 4, 9)).all() and (abs(vectors.planes(5, 5, 1, "uniform", -2, 2)) <= 2).all()


def simpson(f, a, b, n=4000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (b - a) / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 18, 19, 57, 98])
def test_student_series(spark, df):
    density = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    ts = [-3.1, -1.0, 0.0, 0.4, 2.5]
    got = one(spark, *[stats.student_cdf(F.lit(t), df) for t in ts], *[stats.student_cdf_real(F.lit(t), F.lit(float(df))) for t in ts])
    for t, series, real in zip(ts, got[:5], got[5:]):
        want = 0.5 + math.copysign(simpson(density, 0, abs(t)), t)
        assert series == pytest.approx(want, abs=1e-9) and real == pytest.approx(want, abs=1e-9)


def test_tails_and_tests(spark):
    lit = lambda x: F.lit(float(x))
    same = stats.tails(stats.pooled_t(5, lit(1), lit(0), 5, lit(1), lit(0)), 8, lit(1), lit(1))
    lower = stats.tails(stats.pooled_t(5, lit(1), lit(0), 5, lit(2), lit(0)), 8, lit(1), lit(2))
    assert one(spark, *same) == (1.0, 1.0, 1.0) and one(spark, *lower) == (0.0, 0.0, 1.0)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and stats.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert one(spark, stats.f_cdf(lit(1), lit(7), lit(7)))[0] == pytest.approx(0.5) and stats.binomial_tail(2, 4) == 0.6875
    t, df = stats.welch(5, lit(2), lit(1), 10, lit(1), lit(4))
    assert one(spark, t, df) == (pytest.approx(1 / math.sqrt(0.6)), pytest.approx(0.36 / (0.04 / 4 + 0.16 / 9)))
