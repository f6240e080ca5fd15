"""Rank and one-sample tests over arrays of values: ranks come from one sort and one pass over the sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def rank_sums(values: Column, marks: Column) -> Column:
    """Struct of ``ranks``, the sum of the ranks (ties take mean ranks) of values times their ``marks``, and ``ties``, the sum of
    t^3 - t over groups of t equal values. ``marks`` is an array of doubles beside ``values``."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("double").alias("v"), *[zero.alias(c) for c in ("run", "marked", "before", "ranks", "ties")])

    def closed(s: Column) -> tuple[Column, Column]:
        """Sums with the group of equal values that is open."""
        return s["ranks"] + s["marked"] * (s["before"] + (s["run"] + 1.0) / 2), s["ties"] + s["run"] * (s["run"] * s["run"] - 1.0)

    def step(s: Column, x: Column) -> Column:
        same = s["v"].eqNullSafe(x["v"])
        ranks, ties = closed(s)
        keep = lambda now, new: F.when(same, now).otherwise(new)
        return F.struct(
            x["v"].alias("v"), keep(s["run"] + 1.0, F.lit(1.0)).alias("run"), keep(s["marked"] + x["m"], x["m"]).alias("marked"),
            keep(s["before"], s["before"] + s["run"]).alias("before"), keep(s["ranks"], ranks).alias("ranks"), keep(s["ties"], ties).alias("ties"),
        )

    pairs = F.array_sort(F.zip_with(values, marks, lambda v, m: F.struct(v.alias("v"), m.alias("m"))))

    def finish(s: Column) -> Column:
        ranks, ties = closed(s)
        return F.struct(ranks.alias("ranks"), ties.alias("ties"))

    return F.aggregate(pairs, start, step, finish)


def _same(values: Column, mark: float) -> Column:
    return F.transform(values, lambda x: F.lit(mark))


def u_and_ties(a: Column, b: Column, n1: int) -> Column:
    """Struct of ``u``, Mann-Whitney's U of ``a`` (pairs in which its value is above, ties for a half), and ``ties``."""
    sums = rank_sums(F.concat(a, b), F.concat(_same(a, 1.0), _same(b, 0.0)))
    return F.transform(F.array(sums), lambda s: F.struct((s["ranks"] - n1 * (n1 + 1) / 2.0).alias("u"), s["ties"].alias("ties")))[0]


def u_sigma(n1: int, n2: int, ties: Column) -> Column:
    n = n1 + n2
    return F.sqrt(F.greatest(F.lit(0.0), n1 * n2 / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0)))))


def mann_whitney(df: DataFrame, n1: int, n2: int) -> DataFrame:
    """``df`` (a, b arrays) with u, z and the tails p_left, p_right: normal approximation with tie and continuity corrections,
    tails kept within 0.0001 and 0.25. Both groups need five values. Left is small where the first group is lower."""
    if n1 < 5 or n2 < 5:
        raise ValueError("both groups need at least 5 values")
    ranked = df.withColumn("u", u_and_ties(F.col("a"), F.col("b"), n1))
    base = ranked.withColumn("sigma", u_sigma(n1, n2, F.col("u.ties"))).withColumn("u", F.col("u.u"))
    shift = F.col("u") - n1 * n2 / 2.0
    z = F.when(F.col("sigma") > 0, (shift - 0.5 * F.signum(shift)) / F.col("sigma")).otherwise(0.0)
    out = base.withColumn("z", z)
    clamp = lambda p: F.least(F.lit(0.25), F.greatest(F.lit(0.0001), p))
    return out.withColumns({"p_left": clamp(stats.normal_cdf(F.col("z"))), "p_right": clamp(stats.normal_cdf(-F.col("z")))}).drop("sigma")


def _signed(values: Column, centre: float) -> Column:
    """``rank_sums`` of the differences to ``centre`` by size, those above marked; zero differences are left out."""
    d = F.filter(F.transform(values, lambda x: x - centre), lambda x: x != 0)
    return rank_sums(F.transform(d, lambda x: F.abs(x)), F.transform(d, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))


def signed_rank(values: Column, centre: float) -> Column:
    """Wilcoxon W+ of the differences to ``centre``; zero differences are left out, ties take mean ranks."""
    return _signed(values, centre)["ranks"]


def sign_count(values: Column, centre: float) -> tuple[Column, Column]:
    """Values above ``centre``, and values not equal to it."""
    return F.size(F.filter(values, lambda x: x > centre)).cast("long"), F.size(F.filter(values, lambda x: x != centre)).cast("long")


def signed_rank_z(values: Column, centre: float) -> Column:
    """|W+| from its mean in standard deviations, with tie and continuity corrections; 0 where every value is ``centre``."""
    m = F.size(F.filter(values, lambda x: x != centre)).cast("double")

    def z(s: Column) -> Column:
        sigma = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - s["ties"] / 48)
        return F.when(m > 0, F.greatest(F.lit(0.0), F.abs(s["ranks"] - m * (m + 1) / 4) - 0.5) / sigma).otherwise(0.0)

    return F.transform(F.array(_signed(values, centre)), z)[0]


def signed_rank_p(z: Column) -> Column:
    """p of both sides by the normal approximation; ``z`` from :func:`signed_rank_z`, as a column of its own."""
    return F.least(F.lit(1.0), 2 * stats.normal_cdf(-z))


def sign_p(above: Column, n: Column) -> Column:
    """p of both sides of a sign test: ``above`` of ``n`` fair coins, exact."""
    return F.least(F.lit(1.0), 2 * F.least(stats.binomial_cdf(above, n), 1 - stats.binomial_cdf(above - 1, n)))


def jarque_bera(n: Column, skew: Column, excess: Column) -> Column:
    return n / 6.0 * (skew * skew + excess * excess / 4.0)


def jarque_bera_p(jb: Column) -> Column:
    """The limit for many values: chi-square with two degrees of freedom."""
    return F.exp(-jb / 2)
