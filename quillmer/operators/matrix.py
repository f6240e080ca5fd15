"""The feature x sample matrix: sparse counts, normalisation, filters, dense vectors, two-sample tests.

Counts stay long and sparse. What absent samples add to a test is a constant, so tests need one aggregation over present rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats


def row_totals(counts: DataFrame, n_samples: int) -> DataFrame:
    """(kmer, total, zeros)."""
    return counts.groupBy("kmer").agg(F.sum("cnt").alias("total"), (F.lit(n_samples) - F.count("*")).alias("zeros"))


def rarity_filter(counts: DataFrame, n_samples: int, share: float = 0.1) -> DataFrame:
    """k-mers whose total is above ``share`` times the number of samples."""
    return row_totals(counts, n_samples).where(F.col("total") > share * n_samples)


def zero_gate(counts: DataFrame, n_samples: int, share: float = 0.7) -> DataFrame:
    return row_totals(counts, n_samples).where(F.col("zeros") < share * n_samples)


def large_count(counts: DataFrame, n_samples: int, factor: float = 2.0) -> DataFrame:
    return row_totals(counts, n_samples).where(F.col("total") > factor * n_samples)


def dense(counts: DataFrame, samples: list[int], value: str = "cnt") -> DataFrame:
    """(kmer, values): one value per sample in order, 0 where absent. ``samples`` is the manifest's list."""
    m = F.map_from_entries(F.collect_list(F.struct("sample_id", F.col(value).cast("double"))))
    return counts.groupBy("kmer").agg(m.alias("m")).select("kmer", F.transform(F.array(*[F.lit(s) for s in samples]), lambda s: F.coalesce(F.col("m")[s], F.lit(0.0))).alias("values"))


def lognorm(vectors: DataFrame, offsets: dict[int, float], samples: list[int]) -> DataFrame:
    """ln(count + 1) minus the sample's offset, element by element. One offset per sample comes from the driver."""
    off = F.array(*[F.lit(float(offsets.get(s, 0.0))) for s in samples])
    return vectors.withColumn("values", F.zip_with("values", off, lambda c, o: F.log(c + 1) - o))


def per_million(counts: DataFrame, sample_stats: DataFrame) -> DataFrame:
    """(sample_id, kmer, freq): counts by a million of the sample's coverage, the sum of ln(count) of its k-mers."""
    return counts.join(F.broadcast(sample_stats.select("sample_id", "coverage")), "sample_id").select("sample_id", "kmer", (F.col("cnt") * 1e6 / F.col("coverage")).alias("freq"))  # a row per sample


def frequencies(counts: DataFrame, coverage: dict[int, float], group_a: list[int], group_b: list[int]) -> DataFrame:
    """(kmer, a, b, zeros, total): per million of coverage in each group's samples in order, absences, and the sum of counts."""
    samples = group_a + group_b
    scale = F.array(*[F.lit(float(coverage.get(s, 1.0))) for s in samples])
    wide = dense(counts, samples).withColumn("f", F.zip_with("values", scale, lambda c, t: F.when(c > 0, c * 1e6 / t).otherwise(0.0)))
    zeros, total = F.size(F.filter("values", lambda x: x == 0)), F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return wide.select("kmer", F.slice("f", 1, len(group_a)).alias("a"), F.slice("f", len(group_a) + 1, len(group_b)).alias("b"), zeros.alias("zeros"), total.cast("long").alias("total"))


def group_moments(counts: DataFrame, offsets: dict[int, float], group_a: list[int], group_b: list[int]) -> tuple[DataFrame, int, int]:
    """Per k-mer: mean and sample variance of the normalised values in each group of samples (ma, va, mb, vb), and the group sizes.

    Present values are averaged about their mean by the engine; what a group's absent samples add, their offsets with 0 counts,
    follows from sums over the group less those over the present ones. Offsets are taken from their mean, so nothing cancels.
    """
    samples = group_a + group_b
    middle = sum(float(offsets.get(x, 0.0)) for x in samples) / max(1, len(samples))
    o = {x: float(offsets.get(x, 0.0)) - middle for x in samples}
    rows = [(int(x), o[x], g) for g, ids in (("a", group_a), ("b", group_b)) for x in ids]
    known = counts.sparkSession.createDataFrame(rows, "sample_id int, _off double, _grp string")
    met, off = counts.join(F.broadcast(known), "sample_id", "left"), F.coalesce("_off", F.lit(0.0))  # a row per sample
    groups = {"a": group_a, "b": group_b}
    aggs = []
    for g in groups:
        here = F.col("_grp") == g
        v = F.when(here, F.log(F.col("cnt") + 1) - off)
        aggs += [F.count(v).alias("n" + g), F.avg(v).alias("m" + g), F.var_pop(v).alias("q" + g), F.sum(F.when(here, off)).alias("o" + g), F.sum(F.when(here, off * off)).alias("s" + g)]
    present = met.groupBy("kmer").agg(*aggs)

    def finish(g: str, ids: list[int]) -> tuple[Column, Column]:
        size = float(len(ids))
        get = lambda c: F.coalesce(F.col(c + g), F.lit(0.0))
        n, m, q = get("n"), get("m"), get("q")
        absent = size - n
        lost = F.when(absent > 0, -(sum(o[x] for x in ids) - get("o")) / absent).otherwise(0.0)
        spread = F.when(absent > 0, F.greatest(F.lit(0.0), sum(o[x] ** 2 for x in ids) - get("s") - absent * lost * lost)).otherwise(0.0)
        mean = (n * m + absent * lost) / size
        var = (n * q + spread + (m - lost) * (m - lost) * n * absent / size) / max(1.0, size - 1)
        return mean - middle, F.when(var < 1e-12, 0.0).otherwise(var)

    none = (F.lit(None).cast("double"),) * 2
    (ma, va), (mb, vb) = (finish(g, ids) if ids else none for g, ids in groups.items())
    return present.select("kmer", ma.alias("ma"), va.alias("va"), mb.alias("mb"), vb.alias("vb")), len(group_a), len(group_b)


_PRODUCTS = T.StructType([T.StructField("sa", T.IntegerType()), T.StructField("sb", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("c", T.DoubleType())])


def sample_products(vectors: DataFrame, samples: list[int]) -> DataFrame:
    """(sa, sb, n, c), sa <= sb: sums over all rows of products of two samples' deviations from their means.

    ``values`` holds one value per sample in order. A block of rows is one matrix product; a task keeps one number per pair of samples and
    only those are shuffled.
    """
    dim = len(samples)
    mean = np.zeros(dim)
    for pos, m in vectors.select(F.posexplode("values").alias("pos", "v")).groupBy("pos").agg(F.avg("v")).collect():  # a row per sample
        mean[pos] = m
    left, right = np.triu_indices(dim)
    ids = np.asarray(samples, dtype=np.int32)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - mean
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right]), pa.array(np.full(len(left), n)), pa.array(total[left, right])], names=_PRODUCTS.names)

    parts = vectors.select("values").mapInArrow(products, _PRODUCTS)
    return parts.groupBy("sa", "sb").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def correlations(products: DataFrame) -> DataFrame:
    """(sa, sb, n, cov, r) of every two different samples from :func:`sample_products`; r is null where a sample has no variance."""
    own = products.where("sa = sb")
    a, b = own.select("sa", F.col("c").alias("ca")), own.select("sb", F.col("c").alias("cb"))
    met = products.where("sa < sb").join(F.broadcast(a), "sa").join(F.broadcast(b), "sb")  # a row per sample
    return met.select("sa", "sb", "n", (F.col("c") / (F.col("n") - 1)).alias("cov"), (F.col("c") / F.nullif(F.sqrt(F.col("ca") * F.col("cb")), F.lit(0.0))).alias("r"))


def classify(left: Column, right: Column, p: float) -> Column:
    """Left tail first: 'B', then right tail: 'A', else null."""
    return F.when(left <= p, "B").when(right <= p, "A")


def ttest(moments: DataFrame, n1: int, n2: int, p: float = 0.01) -> DataFrame:
    """Moments with t, p_both, p_left, p_right and grp: pooled Student test; an empty group gives p = 1."""
    if not n1 or not n2:
        one = F.lit(1.0)
        return moments.withColumns({"t": F.lit(None).cast("double"), "p_both": one, "p_left": one, "p_right": one, "grp": F.lit(None).cast("string")})
    df = n1 + n2 - 2
    t = stats.pooled_t(n1, F.col("ma"), F.col("va"), n2, F.col("mb"), F.col("vb"))
    out = moments.withColumn("t", t)
    both, left, right = stats.tails(F.col("t"), df, F.col("ma"), F.col("mb"))
    return out.withColumns({"p_both": both, "p_left": left, "p_right": right}).withColumn("grp", classify(F.col("p_left"), F.col("p_right"), p))


TESTS = ("student", "welch", "ftest", "mannwhitney")


def two_sample(df: DataFrame, n1: int, n2: int, test: str = "student", p: float = 0.01) -> DataFrame:
    """``df`` (a, b arrays of ``n1`` and ``n2`` values), the arrays dropped, with t (the test's statistic), p_left, p_right and grp by the chosen test.

    Left is small where the first group is lower (``ftest``: varies less). Without variance the means alone decide, as in :func:`ttest`;
    the F test takes equal variances, zero ones too, for p = 1 on both sides.
    """
    from .ranks import mann_whitney

    if test not in TESTS:
        raise ValueError(f"test must be one of {', '.join(TESTS)}")
    if test == "mannwhitney":
        ranked = mann_whitney(df, n1, n2)
        return ranked.withColumn("t", F.col("u")).withColumn("grp", classify(F.col("p_left"), F.col("p_right"), p)).drop("a", "b", "u", "z")
    mean = lambda v, n: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / max(1, n)
    var = lambda v, m, n: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / max(1, n - 1)
    means = df.withColumns({"ma": mean("a", n1), "mb": mean("b", n2)})
    moments = means.withColumns({"va": var("a", F.col("ma"), n1), "vb": var("b", F.col("mb"), n2)}).drop("a", "b")
    if test == "student" or not n1 or not n2:
        return ttest(moments, n1, n2, p)
    ma, mb, va, vb = (F.col(c) for c in ("ma", "mb", "va", "vb"))
    if test == "welch":
        t, freedom = stats.welch(n1, ma, va, n2, mb, vb)
        flat, cdf = va + vb <= 0, stats.student_cdf_real(F.col("t"), F.col("df"))
        out = moments.withColumns({"t": t, "df": freedom})
        left = F.when(flat, F.when(ma < mb, 0.0).otherwise(1.0)).otherwise(cdf)
        right = F.when(flat, F.when(ma > mb, 0.0).otherwise(1.0)).otherwise(1 - cdf)
    else:
        out = moments.withColumn("t", F.when(vb > 0, va / F.nullif(vb, F.lit(0.0))))
        cdf = stats.f_cdf(F.col("t"), F.lit(n1 - 1.0), F.lit(n2 - 1.0))
        left = F.when(vb > 0, cdf).otherwise(1.0)
        right = F.when(vb > 0, 1 - cdf).when(va > 0, 0.0).otherwise(1.0)
    return out.withColumns({"p_left": left, "p_right": right}).withColumn("grp", classify(F.col("p_left"), F.col("p_right"), p)).drop("df")
