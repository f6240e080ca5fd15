"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Features are all runs of one to three consecutive words. The words of a block of documents are numbered. A feature belongs to its
rarest word: what a word owns around one occurrence is a run of up to five words, so neighbouring features travel together, and
a block deals out its distinct runs with their numbers of occurrences by a hash of the owner. The commonest words (a share of 2**-17 or more, so 131,072
at most) are numbered alike in all blocks and ranked by their counts, all others by a hash; an owner that would fill a part of the dictionary alone has
each of its features dealt out by a hash of the whole feature. The order decides placement only, not results.

Each part of the dictionary adds up its features over all blocks and hashes each distinct feature once, from the hashes of its words. Buckets are
summed over the dictionary; the gain of a bucket compares the target's share with the source's. A part answers each block with the sum of gains
of each of its runs in their order, and the block joins these back to the runs of its documents.

Documents with at least ``min_words`` words are drawn without replacement by the highest sums of weight and Gumbel noise, which is
hashed from the id, so reruns agree.

Defined results: null texts, and texts without words, have no features and weight 0; repeated rows and ids count and are ranked one by one (rows with
all alike in no fixed order); a null id is hashed as an empty string and comes first of equal scores; an empty table of documents gives an empty
table, an empty target gives the gains of no occurrences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, with_dense_ids
from .common import bounded_batches, col, discard, materialize, text_bytes
from .decontam_wm import words_of

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: text of a block, and occurrences of features for each part of the dictionary
BLOCK_BYTES, PART_FEATURES = 14 * 1024 * 1024, 4_000_000
#: groups in which the parts' sums are added up
SUM_GROUPS = 16
#: words of this share (a power of two below one) are numbered alike in all blocks
COMMON = 17
#: an owner's features: columns of a run (the owner, the word before it, after it, before that, after that) in the order of the text
KINDS = ((0,), (1, 0), (0, 2), (3, 1, 0), (1, 0, 2), (0, 2, 4))
#: features that need a column
NEEDS = [sum(1 << f for f, k in enumerate(KINDS) if j in k) for j in range(5)]
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_TABLE = "block long, ids array<long>, lens array<int>, words binary, seq binary, often array<binary>, times array<long>"
_PARTS = "part int, block long, words binary, owners binary, others binary, kinds binary, n binary"
_HASHED = "part int, block long, kinds binary, fresh binary, buckets binary, sums array<long>"
_ANSWERS = "block long, part int, sums binary"
_WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, byte by byte of all, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.uint8)


def _split(b: bytes) -> list[bytes]:
    words = zstandard.decompress(b)
    return words.split(b" ") if words else []


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as numbered words, in blocks: ids and word counts of the documents, the block's distinct words, the words' numbers,
    and the block's common words with their counts."""
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, seqs, size = [], [], 0
        names: dict[bytes, int] = defaultdict(count().__next__)

        def block() -> pa.RecordBatch:
            seq, words = np.concatenate(seqs), list(names)
            n = np.bincount(seq, minlength=len(words))
            often = np.flatnonzero(n >= max(2, len(seq) >> COMMON))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(s) for s in seqs]], pa.list_(pa.int32())),
                pa.array([zstandard.compress(b" ".join(words), 3)], pa.binary()), pa.array([_packed(seq)], pa.binary()),
                pa.array([[words[i] for i in often]], pa.list_(pa.binary())), pa.array([n[often].tolist()], pa.list_(pa.int64())),
            ], names=["block", "ids", "lens", "words", "seq", "often", "times"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                w = words_of(text)
                ids.append(i)
                seqs.append(np.fromiter(map(names.__getitem__, w), np.int32, len(w)))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield block()
                    number, ids, seqs, size = number + 1, [], [], 0
                    names.clear()
                    names.default_factory = count().__next__
        if ids:
            yield block()

    return docs.select(col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(pack, _TABLE)


def stored_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The blocks as an external table, bucketed by block, so that the join back doesn't shuffle them; its place and name."""
    spark = docs.sparkSession
    path = fresh_path(spark, "words")
    name = "blocks_" + path[-32:]
    blocks(docs, id_col, text_col).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    return spark.table(name), path, name


class Layout(NamedTuple):
    """Where features go: the common words, commonest first, how many of them are too common to own a part, and the number of parts."""

    common: list[bytes]
    wide: int
    parts: int


def layout(table: DataFrame) -> Layout:
    parts, total = parts_of(table), words_in(table)
    met = table.select(F.explode(F.arrays_zip("often", "times")).alias("w")).groupBy("w.often").agg(F.sum("w.times").alias("n")).where(F.col("n") >= max(2, total >> COMMON)).collect()  # at most 2**COMMON rows
    ranked = sorted((-r["n"], bytes(r["often"])) for r in met)
    return Layout([w for _, w in ranked], sum(-n * 4 * parts > total for n, _ in ranked), parts)


class Runs:
    """The distinct runs of a block, ordered by their parts. ``rows``: their columns as word numbers from 1, 0 for none; ``kinds``: a bit for
    each feature of the run; ``n``: occurrences. ``at`` and ``docs``: the run and the document of every occurrence."""

    def __init__(self, words: list[bytes], lens: np.ndarray, seq: np.ndarray, to: Layout):
        v, size = len(words), len(seq)
        number = {w: i for i, w in enumerate(to.common)}
        crc = np.fromiter(map(zlib.crc32, words), np.int64, v)
        code = np.fromiter((number.get(w, -1) for w in words), np.int64, v)
        place = np.where(code >= 0, code, len(number) + crc)
        order = np.argsort(place, kind="stable")
        level = np.append(v + 1, np.cumsum(np.diff(place[order], prepend=-1) > 0)).astype(np.int32)  # the rarer, the higher; alike only if the hashes are; the first is none's
        h = np.append(0, crc[order] | 1 << 32).astype(np.uint64)
        self.words, self.code, self.common = [words[i] for i in order], code[order], int((code >= 0).sum())
        wide = int(np.searchsorted(self.code[: self.common], to.wide))
        back = np.empty(v, np.int32)
        back[order] = np.arange(1, v + 1, dtype=np.int32)
        seq, doc = back[seq], np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        runs = np.zeros((5, size), np.int32)
        runs[0] = seq
        for row, d in zip(runs[1:], (-1, 1, -2, 2)):
            if size > abs(d):
                a, b = (slice(None, d), slice(-d, None)) if d < 0 else (slice(d, None), slice(None, -d))
                row[b] = seq[a] * (doc[a] == doc[b])
        own = level[seq]
        before, after, before2, after2 = level[runs[1]] < own, level[runs[2]] <= own, level[runs[3]] < own, level[runs[4]] <= own  # of equals the first owns
        before2 &= before
        after2 &= after
        runs[1:] *= np.stack([before, after, before2, after2])
        has = [np.ones(size, bool), before, after, before2, before & after, after2]
        kinds = sum(x.astype(np.uint8) << f for f, x in enumerate(has)).astype(np.uint8)
        del own, before, after, before2, after2
        if wide:
            alone = seq <= wide
            taken = [(runs[:, ~alone], kinds[~alone], doc[~alone])]
            for f, k in enumerate(KINDS):
                i = np.flatnonzero(alone & has[f])
                one = np.zeros((5, len(i)), np.int32)
                one[list(k)] = runs[list(k)][:, i]
                taken.append((one, np.full(len(i), 1 << f, np.uint8), doc[i]))
            del runs
            runs, kinds, doc = np.concatenate([t[0] for t in taken], axis=1), np.concatenate([t[1] for t in taken]), np.concatenate([t[2] for t in taken])
            del taken
        del has
        # one sort: by owner and the word before it, then by a hash of the rest; what the hash parts or mixes only makes a run come twice
        rest = kinds.astype(np.uint64)
        for row, factor in zip(runs[2:], _FACTORS):
            rest += row.astype(np.uint64) * factor
        key = runs[0].astype(np.int64) * (v + 1) + runs[1]
        if (room := ((1 << 63) - 1) // (v + 1) ** 2) > 1:
            key = key * room + ((rest >> np.uint64(24)) % np.uint64(room)).astype(np.int64)
        del rest
        order = np.argsort(key)
        del key
        runs, kinds = runs[:, order], kinds[order]
        first = np.ones(len(order), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (runs[:, 1:] != runs[:, :-1]).any(axis=0)
        starts = np.flatnonzero(first)
        rows, kinds, n = runs[:, starts], kinds[starts], np.diff(starts, append=len(order))
        at = np.empty(len(order), np.int32)
        at[order] = np.cumsum(first) - 1
        del runs, first, order
        mixed = h[rows[0]] * _FACTORS[0]
        for f, k in enumerate(KINDS):
            i = np.flatnonzero((rows[0] <= wide) & (kinds == 1 << f))
            mixed[i] = sum(h[rows[j, i]] * factor for j, factor in zip(k, _FACTORS))
        part = ((mixed >> np.uint64(29)) % np.uint64(to.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        self.rows, self.kinds, self.n, self.docs = rows[:, order], kinds[order], n[order], doc
        self.starts = np.searchsorted(part[order], np.arange(to.parts + 1))
        placed = np.empty(len(order), np.int32)
        placed[order] = np.arange(len(order), dtype=np.int32)
        self.at = placed[at]

    def sums(self, each: np.ndarray, n: int) -> np.ndarray:
        """Sum of the runs' values over each document."""
        return np.bincount(self.docs, each[self.at], n).astype(np.int64)


def _runs(row: dict, to: Layout) -> Runs:
    return Runs(_split(row["words"]), np.array(row["lens"], np.int64), _unpacked(row["seq"]), to)


def dealt(table: DataFrame, to: Layout) -> DataFrame:
    """The distinct runs of each block by part: words that aren't common, word numbers (common ones first), features and occurrences of the runs."""
    top = len(to.common)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                r = _runs(row, to)
                code = np.append(0, r.code + 1)
                for p in np.flatnonzero(np.diff(r.starts)):
                    own = slice(r.starts[p], r.starts[p + 1])
                    rows = r.rows[:, own]
                    rare = np.unique(rows[rows > r.common])
                    code[rare] = np.arange(top + 1, top + 1 + len(rare))
                    rows = code[rows]
                    others = np.concatenate([c[c > 0] for c in rows[1:]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([zstandard.compress(b" ".join(r.words[i - 1] for i in rare), 3)], pa.binary()),
                        pa.array([_packed(np.diff(rows[0], prepend=0))], pa.binary()), pa.array([_packed(others)], pa.binary()), pa.array([zstandard.compress(r.kinds[own].tobytes(), 3)], pa.binary()), pa.array([_packed(r.n[own])], pa.binary()),
                    ], names=["part", "block", "words", "owners", "others", "kinds", "n"])

    return table.select("block", "lens", "words", "seq").mapInArrow(deal, _PARTS)


@lru_cache(4096)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of each byte of a crc32, a row for each of its four bytes; a crc32 of joined bytes is that of the first after as many zeros, xor that of the rest."""
    zeros, out = bytes(n), np.zeros((4, 256), np.uint32)
    base = zlib.crc32(zeros)
    for bit in range(32):
        row, step = out[bit // 8], 1 << bit % 8
        row[step : 2 * step] = row[:step] ^ np.uint32(zlib.crc32(zeros, 1 << bit) ^ base)
    return out


class Part:
    """A part of the dictionary: distinct features over all blocks, each hashed once."""

    def __init__(self, rows: list[dict], common: list[bytes]):
        top = len(common)
        names: dict[bytes, int] = defaultdict(count(top + 1).__next__)
        grams, n, self.sizes, self.kinds, self.fresh = [], [], [], [], []
        for r in rows:
            rare = np.fromiter(map(names.__getitem__, _split(r["words"])), np.int32)
            kinds = _bytes(r["kinds"])
            runs, others, times, end = np.zeros((5, len(kinds)), np.int64), _unpacked(r["others"]), _unpacked(r["n"]), 0
            runs[0] = np.cumsum(_unpacked(r["owners"]))
            for j in range(1, 5):
                i = np.flatnonzero(kinds & NEEDS[j])
                runs[j, i] = others[end : end + len(i)]
                end += len(i)
            if len(rare):
                runs = np.where(runs > top, rare[np.maximum(runs - top - 1, 0)], runs)
            runs, fresh, size = runs.astype(np.int32), np.zeros(len(kinds), np.uint8), 0
            for f, k in enumerate(KINDS):
                has = (kinds >> f & 1).astype(bool)
                new = has.copy()  # not the feature of the run before
                new[1:] &= ~(has[:-1] & (runs[list(k), 1:] == runs[list(k), :-1]).all(axis=0))
                g = np.zeros((3, int(new.sum())), np.int32)
                g[: len(k)] = runs[list(k)][:, new]
                grams.append(g)
                n.append(np.bincount(np.cumsum(new)[has] - 1, times[has], g.shape[1]).astype(np.int64))
                fresh |= new.astype(np.uint8) << f
                size += g.shape[1]
            self.sizes.append(size)
            self.kinds.append(r["kinds"])
            self.fresh.append(zstandard.compress(fresh.tobytes(), 3))
            del r["words"], r["owners"], r["others"], r["n"]
        g, v = np.concatenate(grams, axis=1), top + len(names) + 1
        grams.clear()
        key, pairs = g[0].astype(np.int64) * v + g[1], None
        if v**3 >= 1 << 63:  # numbers of pairs are smaller than pairs
            pairs, key = np.unique(key, return_inverse=True)
        key *= v
        key += g[2]
        del g
        key, self.at = np.unique(key, return_inverse=True)
        self.at = self.at.astype(np.int32)
        pair, c = np.divmod(key, v)
        a, b = np.divmod(pair if pairs is None else pairs[pair], v)
        self.grams, self.names = (a, b, c), [b"", *common, *names]
        self.n = np.bincount(self.at, np.concatenate(n)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """crc32 of each distinct feature's string, from those of its words."""
        a, b, c = self.grams
        begin = np.fromiter(map(zlib.crc32, self.names), np.uint32, len(self.names))
        space = zlib.crc32(b" ")
        long, which = np.unique(np.fromiter(map(len, self.names), np.int64, len(self.names)) + 1, return_inverse=True)
        step = np.fromiter((zlib.crc32(w, space) for w in self.names), np.uint32, len(self.names))
        tables = np.stack([_zeros(int(n)) for n in long]).ravel()
        out = begin[a]
        for w in (b, c):
            i = np.flatnonzero(w)
            h, more = out[i], w[i]
            base = which[more] << 10
            out[i] = tables[base + (h & 255)] ^ tables[base + (256 + (h >> 8 & 255))] ^ tables[base + (512 + (h >> 16 & 255))] ^ tables[base + (768 + (h >> 24))] ^ step[more]
        return out.astype(np.int64)

    def strings(self) -> list[str]:
        return [b" ".join(self.names[x] for x in g if x).decode() for g in zip(*(x.tolist() for x in self.grams))]


def words_in(table: DataFrame) -> int:
    return table.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def parts_of(table: DataFrame) -> int:
    """Parts of the dictionary: as many as shuffle partitions, or as the words ask for."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * words_in(table) // PART_FEATURES))


def dictionary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(feature, n, bucket): each distinct feature of all documents."""
    table, _ = materialize(blocks(docs, id_col, text_col), "words")
    to = layout(table)

    def read(t: pa.Table) -> pa.Table:
        p = Part(t.to_pylist(), to.common)
        return pa.table({"feature": p.strings(), "n": p.n, "bucket": (p.hashes() % buckets).astype(np.int32)})

    return dealt(table, to).groupBy("part").applyInArrow(read, "feature string, n long, bucket int")


def hashed(table: DataFrame, to: Layout, buckets: int = BUCKETS) -> DataFrame:
    """Of each part, a row for each block with the buckets of its features in the order of its runs (those of the run before aren't repeated), and a
    row (block null) with the occurrences in each bucket."""

    def read(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        p = Part(rows, to.common)
        bucket = p.hashes() % buckets
        sums = np.bincount(bucket, p.n, buckets).astype(np.int64)
        each = bucket.astype(_narrow(buckets))[p.at]
        found = [zstandard.compress(each[e - m : e].tobytes(), 1) for e, m in zip(np.cumsum(p.sizes), p.sizes)]
        n, part = len(rows), rows[0]["part"]
        return pa.table([
            pa.array([part] * (n + 1), pa.int32()), pa.array([*(r["block"] for r in rows), None], pa.int64()), pa.array([*p.kinds, None], pa.binary()), pa.array([*p.fresh, None], pa.binary()), pa.array([*found, None], pa.binary()), pa.array([*[None] * n, sums.tolist()], pa.list_(pa.int64())),
        ], names=["part", "block", "kinds", "fresh", "buckets", "sums"])

    return dealt(table, to).groupBy("part").applyInArrow(read, _HASHED)


def _narrow(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def answers(found: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """For each block and part, the sum of gains of each run in their order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kinds, fresh, each = _bytes(r["kinds"]), _bytes(r["fresh"]), gain[np.frombuffer(zstandard.decompress(r["buckets"]), _narrow(buckets))]
                sums, end = np.zeros(len(kinds), np.int64), 0
                for f in range(len(KINDS)):
                    has, new = (kinds >> f & 1).astype(bool), fresh >> f & 1
                    sums[has] += each[end + np.cumsum(new, dtype=np.int64)[has] - 1]
                    end += int(new.sum())
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["part"]], pa.int32()), pa.array([_packed(sums + (1 << 31))], pa.binary())], names=["block", "part", "sums"])

    return found.where("block IS NOT NULL").drop("sums").mapInArrow(answer, _ANSWERS)


def bucket_sums(found: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets with occurrences. Parts are added up in each task and then in a few groups, so their number doesn't multiply the buckets' rows."""

    def added(columns: Iterator[pa.ListArray]) -> pa.Array:
        total = sum(c.flatten().to_numpy().reshape(len(c), -1).sum(axis=0) for c in columns if len(c))
        return pa.array([total.tolist()] if isinstance(total, np.ndarray) else [], pa.list_(pa.int64()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = added(b.column(0) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUM_GROUPS] * len(sums), pa.int32()), sums], names=["k", "sums"])

    few = found.where("sums IS NOT NULL").select("sums").mapInArrow(add, "k int, sums array<long>")
    few = few.groupBy("k").applyInArrow(lambda t: pa.table({"sums": added(iter(t.column("sums").chunks))}), "sums array<long>")
    return few.select(F.posexplode("sums").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(target's share / source's share)) of each bucket, shares smoothed by one occurrence a bucket."""
    spark = source.sparkSession
    met = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0).collect()  # a row a bucket
    s, t = sum(r["s"] for r in met) + buckets, sum(r["t"] for r in met) + buckets
    x = (F.col("t").cast("double") + 1) * F.lit(float(s)) / ((F.col("s").cast("double") + 1) * F.lit(float(t)))
    rows = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in met], "bucket int, s long, t long").select("bucket", F.floor(1000 * F.log(x)).alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``, as a stored table."""
    spark = docs.sparkSession
    # the target's ids may be of any type and aren't needed
    aim, aim_path = materialize(blocks(target.select(F.lit(0).alias("i"), col(target_text_col).alias("t")), "i", "t"), "target")
    aimed, aimed_path = materialize(hashed(aim, layout(aim), buckets), "target_buckets")
    table, path, name = stored_blocks(docs, id_col, text_col)
    to = layout(table)
    found, found_path = materialize(hashed(table, to, buckets), "buckets")
    gain = np.array(gains(bucket_sums(found), bucket_sums(aimed), buckets), np.int64)

    def weigh(block: pa.Table, back: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        r, lens = _runs(row, to), np.array(row["lens"], np.int64)
        each = np.zeros(len(r.n))
        for p, b in zip(back.column("part").to_pylist(), back.column("sums").to_pylist()):
            each[r.starts[p] : r.starts[p + 1]] = _unpacked(b) - (1 << 31)
        n_features = lens + np.maximum(lens - 1, 0) + np.maximum(lens - 2, 0)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": lens, "n_features": n_features, "weight": r.sums(each, len(lens))})

    told = table.select("block", "ids", "lens", "words", "seq").groupBy("block").cogroup(answers(found, gain, buckets).groupBy("block"))
    out, _ = materialize(told.applyInArrow(weigh, _WEIGHTS), "weights")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, aim_path, aimed_path, path, found_path)
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, hashed from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, **args) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn)."""
    scored = weights(docs, target, **args).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    keyed = scored.withColumn("key", F.struct((~fit).alias("unfit"), (-F.col("score")).alias("low"), "doc_id"))
    placed = with_dense_ids(keyed, "key", "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(fit & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))
