"""Hard-negative mining by distributed radix selection.

A window is an anchor, a kind of label (its own or any other) and a range of scores; wanted are its first ``k`` rows by score, ties
by id. In each pass every task scores its rows against a block of anchors and counts them in a histogram of each window's range, the histograms
are added up, and the bucket that holds the k-th row becomes the window's range. When all rows from there up are few, or the range is one score, they are
gathered; equal scores are refined by the digits of their ids in the same way, so no pass ever gathers a window's rows whole.

The anchors are a stated query set. They go in blocks of ``BLOCK``, numbered in id order; of a block the driver holds its anchors and
a row for each window. A positive's window is all scores of the anchor's label; a negative's is ``low`` to ``high`` percent of the positive's score.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; each component becomes
floor(``scale`` * x); a vector that is shorter than others has zeros for its missing components; rows that share the anchor's id are never its
positives; repeated rows count one by one; an anchor without positives, and a positive without negatives, gives no row; scores that could go
beyond 63 bits are an error; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import with_dense_ids
from .common import bounded_batches, col, discard, fresh_path, materialize

#: anchors of a block; with 4,096 components they take 32 MB
BLOCK = 1024
#: buckets of a histogram
RADIX = 64
#: rows of a window that are gathered without further refinement
FEW = 64
K_POSITIVES, K_NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256

_BUCKETS = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
_FOUND = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Range:
    """Rows of a window's anchor and kind with ``low`` <= score <= ``high``; of those with score ``low``, once ``high`` has come
    down to it, only ids from ``first`` to ``last``. ``need``: the rows still wanted from the range, ``above`` are known to be better."""

    anchor: int
    same: bool
    low: int
    high: int
    need: int
    above: int = 0
    first: int = -(1 << 63)
    last: int = (1 << 63) - 1
    top: int = 0
    done: bool = False

    @property
    def by_id(self) -> bool:
        return self.low == self.high

    @property
    def width(self) -> int:
        """Scores, or ids, of a bucket."""
        span = self.last - self.first + 1 if self.by_id else self.high - self.low + 1
        return -(-span // RADIX)

    def narrowed(self, bucket: int, before: int, here: int) -> Range:
        """The range after a pass: its ``bucket`` holds the last wanted row; ``before`` rows are in better ones, ``here`` in it."""
        r = replace(self, need=self.need - before, above=self.above + before)
        if self.by_id:
            first = self.first + bucket * self.width
            r = replace(r, first=first, last=min(self.last, first + self.width - 1))
            # ids below the bucket are better ones and stay wanted
            end = r.first == r.last
        else:
            high = self.high - bucket * self.width
            r = replace(r, high=high, low=max(self.low, high - self.width + 1))
            end = False
        return replace(r, done=end or r.above + here <= FEW)


def prepared(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components scaled to whole numbers."""
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), F.transform(col(vec_col), lambda x: x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~odd).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def _matrix(values: pa.ListArray, dim: int, kind: type) -> np.ndarray:
    n, at = len(values), values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(kind, copy=False)
    if at[-1] - at[0] == n * dim and (np.diff(at) == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), kind)
    for k, (a, b) in enumerate(zip(at - at[0], at[1:] - at[0])):
        out[k, : b - a] = flat[a:b]
    return out


class Scorer:
    """Scores of rows against the anchors of a block; the rows of each window's range."""

    def __init__(self, rows: DataFrame, dim: int, exact: bool, anchors: list):
        self.rows, self.dim, self.kind = rows, dim, np.float64 if exact else np.int64
        ids, labels = (np.array([a[c] for a in anchors], np.int64) for c in ("vec_id", "label"))
        table = np.zeros((len(anchors), dim), self.kind)
        for i, a in enumerate(anchors):
            table[i, : len(a["v"])] = a["v"]
        self.table = rows.sparkSession.sparkContext.broadcast((table, ids, labels))

    def _run(self, ranges: list[Range], visit, end, schema: T.StructType) -> DataFrame:
        """``visit`` sees, for each batch and open window, the ids and scores of the rows in its range."""
        dim, kind, table = self.dim, self.kind, self.table
        by_anchor: dict[tuple[int, bool], list[tuple[int, Range]]] = {}
        for w, r in enumerate(ranges):
            by_anchor.setdefault((r.anchor, r.same), []).append((w, r))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors, own, labels = table.value
            state: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                scores = anchors @ _matrix(batch.column(2), dim, kind).T
                out: list = []
                for (a, same), windows in by_anchor.items():
                    row = scores[a]
                    fit = (row >= min(r.low for _, r in windows)) & (row <= max(r.top for _, r in windows)) & (((label == labels[a]) & (ids != own[a])) if same else label != labels[a])
                    at = np.flatnonzero(fit)
                    if len(at):
                        s, i = row[at].astype(np.int64), ids[at]
                        for w, r in windows:
                            visit(state, out, w, r, i, s)
                if out:
                    yield _batch(out, schema)
            if out := end(state):
                yield _batch(out, schema)

        return self.rows.mapInArrow(run, schema)

    def histograms(self, ranges: list[Range]) -> DataFrame:
        """(w, bucket, n) over all rows."""

        def visit(state: dict, out: list, w: int, r: Range, ids: np.ndarray, scores: np.ndarray) -> None:
            if r.by_id:
                i = ids[(scores == r.low) & (ids >= r.first) & (ids <= r.last)]
                # the difference of two longs fits an unsigned one
                bucket = (i.astype(np.uint64) - np.uint64(r.first & (1 << 64) - 1)) // np.uint64(r.width)
            else:
                bucket = (r.high - scores[(scores >= r.low) & (scores <= r.high)]) // r.width
            if len(bucket):
                state[w] = state.get(w, 0) + np.bincount(bucket.astype(np.int64), minlength=RADIX)

        end = lambda state: [(np.full(len(b), w), b, n[b]) for w, n in state.items() for b in (np.flatnonzero(n),)]
        return self._run(ranges, visit, end, _BUCKETS).groupBy("w", "bucket").agg(F.sum("n").alias("n"))

    def select(self, ranges: list[Range], k: int) -> DataFrame:
        """(w, vec_id, score, rank): the first ``k`` rows of each window."""
        ranges = [replace(r, top=r.high, done=r.low > r.high) for r in ranges]
        while open_ := [w for w, r in enumerate(ranges) if not r.done]:
            seen = self.histograms([ranges[w] for w in open_])
            order = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            whole = seen.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("w"))})
            needs = self.rows.sparkSession.createDataFrame([(k, ranges[w].need) for k, w in enumerate(open_)], "w int, need long")
            want = F.least("need", "all")
            for x in whole.join(F.broadcast(needs), "w").where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)).collect():  # a row for each window of the block
                w = open_[x["w"]]
                ranges[w] = ranges[w].narrowed(x["bucket"], x["upto"] - x["n"], x["n"])
                open_[x["w"]] = -1
            for w in open_:
                if w >= 0:  # no row at all
                    ranges[w] = replace(ranges[w], done=True, low=1, high=0, top=0)

        def visit(state: dict, out: list, w: int, r: Range, ids: np.ndarray, scores: np.ndarray) -> None:
            fit = (scores >= r.low) & (scores <= r.top)
            if r.by_id:
                fit &= (scores > r.low) | (ids <= r.last)
            if len(at := np.flatnonzero(fit)):
                at = at[np.lexsort((ids[at], -scores[at]))][:k]
                out.append((np.full(len(at), w), ids[at], scores[at]))

        found = self._run(ranges, visit, lambda state: [], _FOUND)
        rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _batch(out: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kinds[f.dataType.simpleString()]) for c, f in zip(zip(*out), schema)], names=schema.names)


def mine(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", k_positives: int = K_POSITIVES, k_negatives: int = K_NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, path = materialize(prepared(vectors, id_col, label_col, vec_col, scale), "vectors")
    anchors, anchors_path = materialize(with_dense_ids(rows.where(is_anchor), "vec_id", "number"), "anchors")
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim, bound = size["dim"] or 0, (size["dim"] or 0) * int(size["most"] or 0) ** 2
    if bound >= 1 << 63:
        raise ValueError(f"scores up to {bound} don't fit 63 bits")
    out = fresh_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(f"{out}/none")
    for start in range(0, anchors.count(), block):
        own = anchors.where(F.col("number").between(start, start + block - 1)).orderBy("number").collect()  # one block
        scorer = Scorer(rows, dim, bound < 1 << 53, own)
        positives = scorer.select([Range(a, True, -bound, bound, k_positives) for a in range(len(own))], k_positives).orderBy("w", "rank").collect()  # k_positives for each anchor of the block
        windows = [Range(p["w"], False, max(-bound, -(-low * p["score"] // 100)), min(bound, high * p["score"] // 100), k_negatives) for p in positives]
        if windows:
            known = spark.createDataFrame([(w, own[p["w"]]["vec_id"], p["vec_id"], p["score"]) for w, p in enumerate(positives)], "w int, anchor_id long, positive_id long, positive_score long")
            found = scorer.select(windows, k_negatives).join(F.broadcast(known), "w")  # a row for each window of the block
            found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("overwrite").parquet(f"{out}/from-{start}")
        scorer.table.unpersist()
    discard(spark, path, anchors_path)
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(out)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The labels of every seventh row moved on, as the query's contract says."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def report(vectors: DataFrame) -> DataFrame:
    return mine(relabelled(vectors), F.col("vec_id") % 100 == 0)


#: the same rows by sorting all scores of each anchor
ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
