"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is cut into ``m`` partitions, correlated bits together. With thresholds t_1..t_m whose sum is
``max_distance - m + 1``, two fingerprints at most ``max_distance`` bits apart differ in at most t_i bits in some partition i.
The thresholds (-1 leaves a partition out) and ``m`` are chosen by dynamic programming over estimated candidate and probe
counts. Each distinct fingerprint is indexed under its own value of a partition and probes the values up to t_i flips away;
what meets under one key is verified on all 64 bits. Only the connectivity of a key's members goes on: one link from each
member to its local root, never all pairs.

Defined results: a null text has no words; no words give fingerprint zero, which links like any other; documents with equal
fingerprints are one class, however many; repeated rows stay as they are, one result row each; a null doc_id takes part, and
a component of null ids alone has a null component_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col, discard, fresh_name, materialize, text_bytes

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: fingerprints in the sample from which bit correlations and candidate counts are estimated
SAMPLE_FINGERPRINTS = 3000
#: members of one key that a task compares with each other; larger keys are split into pairs of tiles of this size
TILE = 1024
#: pairs that are verified at once
CHUNK_PAIRS = 1 << 21
#: rows of a counted table of hot keys up to which it is broadcast (16 bytes each); beyond, the join shuffles
MAX_BROADCAST_ROWS = 200_000
#: cost of a probe row (expanded, shuffled and sorted) against that of verifying a candidate pair
PROBE_COST = 40.0


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of a text in UTF-8: majority bits of XXH64 over all shingles, repeats included."""
    w = text.lower().split()  # on bytes both take ASCII only
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(w) < SHINGLE_WORDS:
        return h64(b" ".join(w), SEED)
    h = np.array([h64(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(SHINGLE_WORDS))))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def fingerprint_column(text_col: str = "text") -> Column:
    """The fingerprint of a row's text as a signed 64-bit integer."""
    return _fingerprints(text_bytes(text_col))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- plan -------------------------------------------------------------------------------------------------------------


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each grows by the bit that correlates most with it."""
    x = bits.astype(float) - bits.mean(0)
    s = np.sqrt((x * x).mean(0)) + 1e-9
    corr = np.abs(x.T @ x / max(1, len(x)) / np.outer(s, s))
    left, groups = list(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        sub = corr[np.ix_(left, left)] - np.eye(len(left))
        group = [left[int(sub.sum(1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, n: int, max_distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """The (bit mask, threshold) pairs with the least estimated cost for ``n`` distinct fingerprints.

    Any such plan finds every link; the sample decides the cost alone.
    """
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    bits = _bit_matrix(sample) if len(sample) > 1 else np.zeros((2, 64))
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, max_distance + 2):
        groups = group_bits(bits, m)
        masks = [sum(1 << b for b in g) for g in groups]
        cost = []
        for g, mask in zip(groups, masks):
            near = np.zeros(max_distance + 1)
            for i in range(0, len(sample), 256):
                d = np.bitwise_count((sample[i : i + 256, None] ^ sample[None, i:]) & np.uint64(mask))
                near += np.bincount(np.minimum(d[np.triu_indices(d.shape[0], 1, d.shape[1])], max_distance + 1).astype(int), minlength=max_distance + 2)[:-1]
            row = [0.0]
            for t in range(max_distance + 1):
                probes = sum(comb(len(g), j) for j in range(t + 1))
                share = max(near[: t + 1].sum() / pairs, probes / 2.0 ** len(g))
                row.append(n * (n - 1) / 2 * share + PROBE_COST * n * (probes + (t > 0)))
            cost.append(row)
        # table[u]: least cost and thresholds (+1) with u units given to the partitions so far
        table = {0: (0.0, [])}
        for row in cost:
            new: dict = {}
            for u, (c, chosen) in table.items():
                for t in range(min(max_distance + 1, max_distance + 1 - u) + 1):
                    if c + row[t] < new.get(u + t, (np.inf,))[0]:
                        new[u + t] = (c + row[t], [*chosen, t])
            table = new
        total, chosen = table[max_distance + 1]
        if total < best[0]:
            best = (total, [(mask, t - 1) for mask, t in zip(masks, chosen) if t > 0])
    return best[1]


def _flips(mask: int, t: int) -> np.ndarray:
    """All XOR patterns of 1 to ``t`` bits within ``mask``."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([sum(c) for j in range(1, t + 1) for c in combinations(bits, j)], dtype=np.uint64)


# --- candidates and verification --------------------------------------------------------------------------------------

_KEYED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("probe", T.BooleanType()), T.StructField("fp", T.LongType())])
_LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _keyed(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """Each fingerprint under its own key of each partition and under the keys up to the threshold away."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [_flips(mask, t) for mask, t in parts]
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 4096):
                fp = x[i : i + 4096]
                for p, (mask, _) in enumerate(parts):
                    own = fp & np.uint64(mask)
                    for start in range(-64, len(flips[p]), 64):  # its own key first
                        f = np.zeros(1, np.uint64) if start < 0 else flips[p][start : start + 64]
                        key = (own[None, :] ^ f[:, None]).ravel()
                        n = len(key)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(n, start >= 0)), pa.array(np.tile(fp, len(f)).view(np.int64))], names=["part", "key", "probe", "fp"])

    return fps.select("fp").mapInArrow(expand, _KEYED)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position connected with each of ``n`` positions by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    return root


def _links_of_runs(run: np.ndarray, probe: np.ndarray, fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to its local root, for rows sorted by run with index rows before probes."""
    n = len(fp)
    last = np.searchsorted(run, run, side="right")
    todo = np.where(probe, 0, last - np.arange(n) - 1)
    ends = np.cumsum(todo)
    found = []
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_PAIRS, side="right")))
        k = todo[at:stop]
        if total := int(k.sum()):
            i = np.repeat(np.arange(at, stop), k)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(k) - k, k)
            d = np.bitwise_count(fp[i] ^ fp[j])
            ok = (d <= max_distance) & (d > 0)
            found.append((i[ok], j[ok]))
        at = stop
    if not found:
        return fp[:0].view(np.int64), fp[:0].view(np.int64)
    root = _local_roots(n, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
    moved = np.flatnonzero(root != np.arange(n))
    u, v = fp[moved], fp[root[moved]]
    return np.maximum(u.view(np.int64), v.view(np.int64)), np.minimum(u.view(np.int64), v.view(np.int64))


def _verify(keyed: DataFrame, max_distance: int) -> DataFrame:
    """Links within each (part, key, tile pair), walking sorted runs; the run that is open goes on to the next batch."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def emit(c: list[np.ndarray]):
            part, key, pair, probe, fp = c
            new = np.ones(len(fp), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            u, v = _links_of_runs(np.cumsum(new), probe, fp.view(np.uint64), max_distance)
            ok = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], names=["u", "v"])

        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(c[0]):
                continue
            if kept is not None:
                c = [np.concatenate(x) for x in zip(kept, c)]
            same = (c[0] == c[0][-1]) & (c[1] == c[1][-1]) & (c[2] == c[2][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield emit([x[:cut] for x in c])
            kept = [x[cut:] for x in c]
        if kept is not None and len(kept[0]):
            yield emit(kept)

    tiles = F.ceil(F.col("size") / TILE).cast("int").alias("tiles")
    hot = keyed.groupBy("part", "key").agg(F.count("*").alias("size")).where(F.col("size") > TILE).select("part", "key", tiles)
    hot, _ = materialize(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_ROWS else hot
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(hot, ["part", "key"], "left")
        .withColumn("tile", F.when(F.col("tiles").isNull(), 0).otherwise(tile))
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
        .select("part", "key", (F.least("tile", "other").cast("long") * (1 << 31) + F.greatest("tile", "other")).alias("pair"), "probe", "fp")
    )
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part", "key", "pair").sortWithinPartitions("part", "key", "pair", "probe").mapInArrow(walk, _LINK)


def links(fps: DataFrame, *, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (u > v) between distinct fingerprints (column fp) whose connected components are those of all pairs
    at most ``max_distance`` bits apart."""
    n = fps.count()
    every = max(1, n // SAMPLE_FINGERPRINTS)
    sample = fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(every)) == 0).select("fp").toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    keyed, path = materialize(_keyed(fps, plan(np.sort(sample), n, max_distance)), "keyed")
    found, _ = materialize(_verify(keyed, max_distance).distinct(), "links")
    discard(fps.sparkSession, path)
    return found


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): alternating large and small stars until nothing changes.

    Every step groups by a node with partial aggregation and joins the minimum back, so that a hub is never gathered in
    one task; each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new, new_path = materialize(small, "edges")
        got = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        discard(spark, path)
        now, path = new, new_path
        if got == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        digest = got


# --- operators --------------------------------------------------------------------------------------------------------


def fingerprint_components(pairs: DataFrame, *, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, component_id, best) per distinct fp of ``pairs`` (doc_id, fp): root names the component by a fingerprint, component_id
    by its smallest doc_id, best is the (null id?, doc_id, fp) of the document that stands for it."""
    fps, _ = materialize(pairs.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    root = components(links(fps, max_distance=max_distance))
    rooted = fps.join(root, fps.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lead = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("doc_id"), "fp")).alias("best"))
    return rooted.join(lead, "root").select("fp", "root", F.col("best.doc_id").alias("component_id"), "best")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    bounded_batches(docs.sparkSession)
    pairs, _ = materialize(docs.select(col(id_col).alias("doc_id"), fingerprint_column(text_col).alias("fp")), "fingerprints")
    of = fingerprint_components(pairs, max_distance=max_distance).select("fp", "component_id")
    return pairs.join(of, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: documents to drop that are broadcast (about 64 bytes each in memory); beyond, rows are shuffled by their keys
MAX_BROADCAST_DROPPED = 1_000_000


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs``, columns untouched, that stand for their components: the smallest doc_id, one row of it.

    What goes is decided on narrow keys (id and a 128-bit hash of the text); fingerprints are computed once. The rows
    themselves stay where they are unless the keys to drop are too many to broadcast.
    """
    from pyspark.sql import Window

    bounded_batches(docs.sparkSession)
    t = F.coalesce(col(text_col), F.lit(""))
    key = F.struct(col(id_col).alias("i"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))
    pairs, _ = materialize(docs.select(key.alias("key"), col(id_col).alias("doc_id"), fingerprint_column(text_col).alias("fp")), "fingerprints")
    of = fingerprint_components(pairs, max_distance=max_distance).select("fp", "best")
    keys = pairs.groupBy("key", "fp").agg(F.count("*").alias("n")).join(of, "fp")
    stays = (F.col("fp") == F.col("best.fp")) & F.col("key.i").eqNullSafe(F.col("best.doc_id"))
    judged, _ = materialize(keys.select("key", "n", F.when(stays, F.col("best")).alias("best")), "judged")
    # a representative's id and fingerprint may belong to several texts: the smallest key stands
    some = judged.where("best is not null")
    lead = some.groupBy("best").agg(F.min("key").alias("lead"))
    lead = some.join(lead, "best").select("key", "n", (F.col("key") == F.col("lead")).alias("leads"))
    lead, _ = materialize(lead.where("not leads or n > 1"), "lead")
    gone, again = judged.where("best is null").select("key").union(lead.where("not leads").select("key")), lead.where("leads").select("key")
    row, mine = fresh_name(docs, "row"), fresh_name(docs, "mine")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), key.alias(mine))
    small = lambda d: F.broadcast(d) if d.count() <= MAX_BROADCAST_DROPPED else d
    in_ = lambda d: F.col(mine).eqNullSafe(d["key"])
    gone = small(gone)
    stay = rows.join(gone, in_(gone), "left_anti")
    if again.isEmpty():
        return stay.select(f"{row}.*")
    again = small(again)
    one = Window.partitionBy(mine).orderBy(F.xxhash64(row))
    first = stay.join(again, in_(again), "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return stay.join(again, in_(again), "left_anti").select(f"{row}.*").union(first.select(f"{row}.*"))
