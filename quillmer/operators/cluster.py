"""Clustering of vectors: sign-projection buckets, greedy merging within a bucket, rounds with a falling threshold.

Deterministic under any partitioning: planes are seeded, rows of a bucket are walked in id order, and a merged cluster takes
its smallest id. Membership is a mapping table (feature_id, cluster_id), never an array in a row.

Equal vectors are one weighted row from the start (they would merge at any threshold), so copies never fill a bucket. A bucket above the threshold is
split by fresh planes, its parts again, and what planes can't part (vectors of one direction) goes in pieces by a hash of
the id, which meet again in later rounds. So a task never walks more rows of a bucket than the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import planes
from ..storage import discard, materialize, stored

#: oversized buckets (a row each) up to which their table is broadcast
MAX_BROADCAST_ROWS = 200_000
#: times that a bucket is split by planes before it goes in pieces
LEVELS = 3

_MERGED = T.StructType([T.StructField("old_id", T.LongType()), T.StructField("cluster_id", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])


def schedule(min_similarity: float, iterations: int, start: float = 0.95) -> list[float]:
    """Threshold of each round: falls from ``start`` by equal steps and stops one step above ``min_similarity``."""
    step = (start - min_similarity) / iterations
    return [start - i * step for i in range(iterations)]


def greedy(values: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge each row into the first earlier row with cosine >= ``threshold``; the last row takes the place of a merged one
    and is looked at next. Returns the slot of each row, and centroids and weights by slot. Zero vectors never merge."""
    v, w = values.copy(), weights.astype(float).copy()
    n, size = len(v), len(v)
    norms = np.sqrt((v * v).sum(1))
    row = list(range(n))  # original row in each slot
    merged_into = np.arange(n)
    i = 1
    while i < size:
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.flatnonzero((v[:i] @ v[i]) / (norms[:i] * norms[i]) >= threshold)
        if len(near):
            j = int(near[0])
            total = w[j] + w[i]
            v[j] = (v[j] * w[j] + v[i] * w[i]) / total
            w[j], norms[j] = total, math.sqrt(float(v[j] @ v[j]))
            merged_into[row[i]] = row[j]
            size -= 1
            v[i], w[i], norms[i], row[i] = v[size], w[size], norms[size], row[size]
        else:
            i += 1
    return merged_into, v[:size], np.array(row[:size])


def merge_run(ids: np.ndarray, values: np.ndarray, weights: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(old id, cluster id, centroid or None, n) of one bucket's rows in id order; each cluster's values stand in one row."""
    if len(ids) == 1:
        yield ids[0], ids[0], values[0], weights[0]
        return
    into, centroids, heads = greedy(values, weights, threshold)
    at = {h: c for h, c in zip(heads.tolist(), centroids)}
    groups: dict[int, list[int]] = {}
    for r, h in enumerate(into.tolist()):
        groups.setdefault(h, []).append(r)
    for h, rows in groups.items():
        new = min(int(ids[r]) for r in rows)
        for k, r in enumerate(rows):
            yield int(ids[r]), new, at[h] if k == 0 else None, int(sum(weights[x] for x in rows)) if k == 0 else None


def bucket_key(bits: int, dim: int, seed: int) -> Column:
    """Bucket of the vector column ``values`` among 2^bits."""
    table = planes(bits, dim, seed)
    powers = 1 << np.arange(bits, dtype=np.int64)[::-1]

    @F.pandas_udf(T.LongType())
    def key(values: pd.Series) -> pd.Series:
        if not len(values) or not bits:
            return pd.Series(np.zeros(len(values), np.int64))
        return pd.Series((np.stack(values.to_list()) @ table.T >= 0) @ powers)

    return key(F.col("values"))


def with_buckets(clusters: DataFrame, n: int, dim: int, seed: int, bucket_threshold: int, temporary: list[str] | None = None) -> DataFrame:
    """``clusters`` with bucket, of at most about ``bucket_threshold`` rows each; places of tables to discard go to ``temporary``."""
    bits = int(math.log2(n)) if n > 1 else 0
    keyed = clusters.withColumn("bucket", bucket_key(bits, dim, seed))
    if n <= bucket_threshold:  # no bucket can be larger
        return keyed
    for level in range(1, LEVELS + 2):
        keyed, path = materialize(keyed, "buckets")
        if temporary is not None:
            temporary.append(path)
        large = keyed.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_threshold).select("bucket", F.ceil(F.col("rows") / bucket_threshold).alias("parts"))
        most = large.agg(F.max("parts"), F.count("*")).first()
        if most[0] is None:
            break
        large = F.broadcast(large) if most[1] <= MAX_BROADCAST_ROWS else large
        deepest = int(math.log2(most[0])) + 1
        if level <= LEVELS:  # as many planes as the bucket needs, of those of the largest
            keyed = keyed.withColumn("fine", bucket_key(deepest, dim, seed + level * 1_000_003))
            part = F.expr(f"shiftright(fine, {deepest - 1} - CAST(floor(log2(parts)) AS INT))")
        else:
            keyed, part = keyed.withColumn("fine", F.lit(0)), F.pmod(F.xxhash64("cluster_id"), F.col("parts"))
        # a clash of these keys only joins two buckets
        split = F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.lit(level), part))
        keyed = keyed.join(large, "bucket", "left").withColumn("bucket", split).drop("fine", "parts")
    return keyed


def merge_round(clusters: DataFrame, threshold: float, *, n: int, dim: int, seed: int, bucket_threshold: int, temporary: list[str] | None = None) -> DataFrame:
    """(old_id, cluster_id, values, n): runs of a bucket are walked in sorted partitions; a run may go over Arrow batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def rows(parts: list) -> list[tuple]:
            ids, values, weights = (np.concatenate(x) for x in zip(*parts))
            return list(merge_run(ids, values, weights, threshold))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            old, new, values, n = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(old, pa.int64()), pa.array(new, pa.int64()), pa.array([None if v is None else list(v) for v in values], pa.list_(pa.float64())), pa.array(n, pa.int64())], names=_MERGED.names)

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            b, ids, weights = (batch.column(k).to_numpy() for k in (0, 1, 3))
            values = batch.column(2).flatten().to_numpy().reshape(m, dim)
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            out: list[tuple] = []
            for s, e in zip(starts, np.append(starts[1:], m)):
                if key is not None and b[s] != key:
                    out += rows(held)
                    held = []
                key = b[s]
                held.append((ids[s:e], values[s:e], weights[s:e]))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(rows(held))

    keyed = with_buckets(clusters, n, dim, seed, bucket_threshold, temporary).select("bucket", "cluster_id", "values", "n")
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "cluster_id").mapInArrow(walk, _MERGED)


def equal_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal ``vectors`` (cluster_id, values, n) as one row with their smallest id and all their weight; and (old_id, cluster_id) of the others.
    Vectors that never merge stay alone: zero ones and those with a null or non-finite value."""
    fit = F.coalesce(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("values", lambda x: x != 0), F.lit(False))
    own = vectors.where(fit)
    grouped = own.groupBy("values").agg(F.min("cluster_id").alias("first"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    classes = grouped.select(F.col("first").alias("cluster_id"), "values", "n").unionByName(vectors.where(~fit).select("cluster_id", "values", "n"))
    # one side of the join is unique, so a large class can be split on the other
    moved = own.select("values", F.col("cluster_id").alias("old_id")).join(grouped.where("rows > 1").select("values", F.col("first").alias("cluster_id")), "values").where("old_id <> cluster_id")
    return classes, moved.select("old_id", "cluster_id")


def resolved(moves: DataFrame) -> DataFrame:
    """(old_id, cluster_id): where each id has come to at last, from all rounds' moves; an id moves once. Chains halve in each pass."""
    spark = moves.sparkSession
    now, path = materialize(moves.select("old_id", "cluster_id"), "moves")
    while True:
        up = now.select(F.col("old_id").alias("cluster_id"), F.col("cluster_id").alias("up"))
        after, new = materialize(now.join(up, "cluster_id", "left").select("old_id", F.coalesce("up", "cluster_id").alias("cluster_id"), F.col("up").isNotNull().alias("moved")), "moves")
        discard(spark, path)
        if after.where("moved").isEmpty():
            return after.select("old_id", "cluster_id")
        now, path = after, new


def cluster(vectors: DataFrame, dim: int, *, min_similarity: float = 0.8, iterations: int = 100, bucket_threshold: int = 20_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of ``vectors`` (cluster_id, values, n). Each round is a stored table, deleted when the next one is written."""
    spark = vectors.sparkSession
    start = stored(vectors.select("cluster_id", "values", "n"), "vectors")
    classes, moved = equal_classes(start)
    now, path = materialize(classes, "clusters")
    moves = stored(moved, "moves")
    for i, threshold in enumerate(schedule(min_similarity, iterations)):
        n = now.count()
        if n <= 1:
            break
        temporary = [path]
        merged, path = materialize(merge_round(now, threshold, n=n, dim=dim, seed=seed + i, bucket_threshold=bucket_threshold, temporary=temporary), "round")
        discard(spark, *temporary)
        now = merged.where(F.col("values").isNotNull()).select("cluster_id", "values", "n")
        moves = moves.unionByName(stored(merged.where("old_id <> cluster_id").select("old_id", "cluster_id"), "moves"))
    ids = start.select(F.col("cluster_id").alias("feature_id"))
    last = resolved(moves).select(F.col("old_id").alias("feature_id"), "cluster_id")
    return now, ids.join(last, "feature_id", "left").select("feature_id", F.coalesce("cluster_id", "feature_id").alias("cluster_id"))


def consensus(rows: DataFrame, by: str) -> DataFrame:
    """Size-weighted mean vector and total size of each group: (by, pos, value, n) in long form."""
    each = rows.select(by, "n", F.posexplode("values").alias("pos", "x"))
    return each.groupBy(by, "pos").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def test_clusters(clusters: DataFrame, n1: int, n2: int, *, p: float = 0.01, size_threshold: int = 500_000, test: str = "student") -> DataFrame:
    """Clusters of more than ``size_threshold`` members, tested on their centroids (first ``n1`` values against the rest) by the
    ``student``, ``welch``, ``ftest`` or ``mannwhitney`` test."""
    from .matrix import two_sample

    return two_sample(clusters.where(F.col("n") > size_threshold).select("cluster_id", "n", F.slice("values", 1, n1).alias("a"), F.slice("values", n1 + 1, n2).alias("b")), n1, n2, test, p)


def similar_pairs(vectors: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """Pairs (id_a < id_b, bucket, similarity) of one bucket with cosine >= ``threshold``, between representatives of equal vectors.

    Equal vectors (id, values) stand as their smallest id, so copies make no pairs. The key has floor(log2 n) bits, at most as many
    as ``table`` has planes, so a bucket holds one vector on average whatever n is.
    """
    from ..functions.vectors import cosine_distance, srp_key

    one = stored(vectors.groupBy("values").agg(F.min("id").alias("id")), "representatives")
    n = one.count()
    keyed = one.withColumn("bucket", srp_key(F.col("values"), table[: int(math.log2(n)) if n > 1 else 0]))
    a = keyed.select("bucket", F.col("id").alias("id_a"), F.col("values").alias("va"))
    b = keyed.select("bucket", F.col("id").alias("id_b"), F.col("values").alias("vb"))
    return a.join(b, "bucket").where("id_a < id_b").withColumn("similarity", 1 - cosine_distance(F.col("va"), F.col("vb"))).where(F.col("similarity") >= threshold).select("id_a", "id_b", "bucket", "similarity")
