"""Counting: k-mer counts by sample, features, coverage; the database view of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq
from ..schema import COUNTS
from ..storage import fresh_path, materialize, scan_bytes, spread, stored, with_dense_ids


#: k from which k-mers go to their counters as super-k-mers: shorter ones repeat so often that counts of batches are smaller
PACKED_FROM = 15
#: length of signatures; bins of them, at least; bytes of scanned input for a further bin
SIGNATURE, BINS, BIN_BYTES = 9, 128, 1024 * 1024
#: k-mers of a bin that one task counts, and that it counts together: about 60 bytes for each
BIN_KMERS, FLUSH = 4_000_000, 1_000_000
#: bases of a block of one sample's reads, and of all that a task holds; k-mers of a batch that a block asks for
BLOCK_BASES, HELD_BASES, ASKED = 4 << 20, 64 << 20, 250_000
#: large bins (a row each) up to which their table is broadcast
MAX_BROADCAST_BINS = 200_000

_PACKED = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("runs", T.BinaryType()), T.StructField("bases", T.BinaryType())])


def count_kmers(reads: DataFrame, k: int, *, min_count: int = 2, max_count: int = 65535, invalid: str = "skip", both_strands: bool = True, samples: int | None = None) -> DataFrame:
    """(sample_id, kmer, cnt): packed canonical k-mers seen at least ``min_count`` times in a sample, counts saturated.

    Small scans are dealt out first. Short k-mers are combined in each batch before the shuffle, longer ones of both strands go as super-k-mers.
    ``samples`` is their number, counted if not given.
    """
    if k >= PACKED_FROM and both_strands:
        total = count_packed(pack_super_kmers(reads, k, samples=samples, invalid=invalid), k)
    else:
        partial = seq.count_in_batches(spread(reads), k, invalid=invalid, both_strands=both_strands)
        total = partial.groupBy("sample_id", "kmer").agg(F.sum("cnt").alias("cnt"))
    return total.where(F.col("cnt") >= min_count).withColumn("cnt", F.least("cnt", F.lit(max_count).cast("long")))


def pack_super_kmers(reads: DataFrame, k: int, *, m: int = SIGNATURE, bins: int | None = None, samples: int | None = None, invalid: str = "skip") -> DataFrame:
    """(sample_id, bin, n, runs, bases): the super-k-mers of a batch of reads by bin of their signature, two bits a base.

    All occurrences of a canonical k-mer have one signature and so one bin. ``runs`` has a byte for each super-k-mer, its number of
    k-mers (longer runs are cut), ``n`` is their sum. Each sample has bins for its share of the input, so a batch's rows don't get shorter with the number of samples.
    """
    if not bins:
        samples = samples or max(1, reads.select("sample_id").distinct().count())
        bins = max(BINS, scan_bytes(reads) // BIN_BYTES // samples)
    bins = min(bins, 4**m // 4)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seq.signature_table(m)
        for batch in batches:
            for samples, seqs in seq.groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, begin, _ = seq.joined(seqs)
                start, n, low = seq.signature_runs(raw, k, m, table, invalid)
                pieces = -(-n // 255)
                start, n, low = np.repeat(start, pieces), np.repeat(n, pieces), np.repeat(low, pieces)
                nth = np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, n = start + 255 * nth, np.minimum(255, n - 255 * nth)
                sample = np.array(samples, np.int64)[np.searchsorted(begin, start, "right") - 1]
                # a multiplicative hash: neighbouring signatures are unequally frequent
                group = sample * bins + ((low * 0x9E3779B1 & 0xFFFFFFFF) * bins >> 32)
                order = np.argsort(group, kind="stable")
                start, n, group = start[order], n[order], group[order]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                if not len(first):
                    continue
                ends = np.append(first[1:], len(group))
                bases, lengths = seq.two_bits(raw, start, n + k - 1, first, ends, invalid)
                yield pa.RecordBatch.from_arrays([
                    pa.array((group[first] // bins).astype(np.int32)), pa.array((group[first] % bins).astype(np.int32)), pa.array(np.add.reduceat(n, first)),
                    _binary(n.astype(np.uint8), ends - first), _binary(bases, lengths),
                ], names=_PACKED.names)

    return spread(reads.select("sample_id", "seq").where("sample_id IS NOT NULL")).mapInArrow(pack, _PACKED)  # groups leave null sequences out


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined bytes of binary values without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(ends).astype(np.int64), np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy()


def count_packed(packed: DataFrame, k: int, *, bin_kmers: int = BIN_KMERS) -> DataFrame:
    """(sample_id, kmer, cnt) of the k-mers of packed super-k-mers, each row's occurrences together.

    A task sorts the k-mers of whole bins, so no k-mer crosses the network by itself. A bin of more than ``bin_kmers`` is dealt out by a hash of its rows,
    and the counts of its parts are added up.
    """
    packed, _ = materialize(packed, "super_kmers")
    size = packed.groupBy("sample_id", "bin").agg(F.sum("n").alias("n"))
    large = stored(size.where(F.col("n") > bin_kmers).select("sample_id", "bin", F.ceil(F.col("n") / bin_kmers).cast("int").alias("parts")), "large_bins")
    n_large = large.count()
    # tasks of about BIN_KMERS each, as many as the input asks for
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.agg(F.sum("n")).first()[0] or 0) // BIN_KMERS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0  # held: stretches of rows as arrays

        def flush() -> Iterator[pa.RecordBatch]:
            samples, n, n_runs, runs, n_bytes, bases = (np.concatenate(x) for x in zip(*held))
            held.clear()
            kmer = seq.kmers_of_rows(n, n_runs, runs, n_bytes, bases, k)
            first = np.flatnonzero(np.diff(samples, prepend=samples[0] - 1))  # rows come by sample
            ends = np.cumsum(n)
            bounds = [*(ends[first] - n[first]), len(kmer)]
            for sample, x, y in zip(samples[first].tolist(), bounds, bounds[1:]):
                distinct, cnt = np.unique(kmer[x:y], return_counts=True)
                for i in range(0, len(distinct), ASKED):
                    own = distinct[i : i + ASKED]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), sample, np.int32)), pa.array(own), pa.array(cnt[i : i + ASKED].astype(np.int64))], names=COUNTS.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]])
            n = batch.column(3).to_numpy()
            (n_runs, runs), (n_bytes, bases) = _flat(batch.column(4)), _flat(batch.column(5))
            at_run, at_byte = np.append(0, np.cumsum(n_runs)), np.append(0, np.cumsum(n_bytes))
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            begins = new.tolist() if key == tuple(keys[:, 0]) else [0, *new.tolist()]
            key, total, start = tuple(keys[:, -1]), np.append(0, np.cumsum(n)), 0

            def hold(x: int, y: int) -> None:
                if y > x:
                    held.append((keys[0, x:y], n[x:y], n_runs[x:y], runs[at_run[x] : at_run[y]], n_bytes[x:y], bases[at_byte[x] : at_byte[y]]))

            for i in begins:  # a key's rows are counted together
                if size + total[i] - total[start] >= FLUSH:
                    hold(start, i)
                    yield from flush()
                    start, size = i, 0
            hold(start, batch.num_rows)
            size += int(total[-1] - total[start])
        if held:
            yield from flush()

    def counted(rows: DataFrame) -> DataFrame:
        by = ["sample_id", "bin", "part"]
        dealt = rows.select(*by, "n", "runs", "bases").repartition(tasks, *by).sortWithinPartitions(*by)
        return dealt.mapInArrow(count, COUNTS)

    if not n_large:
        return counted(packed.withColumn("part", F.lit(0)))
    large = F.broadcast(large) if n_large <= MAX_BROADCAST_BINS else large
    whole = counted(packed.join(large, ["sample_id", "bin"], "left_anti").withColumn("part", F.lit(0)))
    parts = counted(packed.join(large, ["sample_id", "bin"]).withColumn("part", F.pmod(F.xxhash64("runs", "bases"), F.col("parts")).cast("int")))
    return whole.unionByName(parts.groupBy("sample_id", "kmer").agg(F.sum("cnt").alias("cnt")))


def universe(counts: DataFrame) -> DataFrame:
    """The distinct k-mers of all samples."""
    return counts.select("kmer").distinct()


def features(counts: DataFrame) -> DataFrame:
    """(feature_id, kmer): ids 0, 1, ... in k-mer order."""
    return with_dense_ids(universe(counts), "kmer", "feature_id").select("feature_id", "kmer")


def sample_stats(counts: DataFrame) -> DataFrame:
    """(sample_id, coverage, n_features, offset): sum of ln(count), size of the union key space, their ratio."""
    n = universe(counts).agg(F.count("*").alias("n_features"))
    coverage = counts.groupBy("sample_id").agg(F.sum(F.log("cnt")).alias("coverage"))
    return coverage.crossJoin(F.broadcast(n)).withColumn("offset", F.col("coverage") / F.col("n_features"))  # n is one row


def db_info(counts: DataFrame, k: int) -> DataFrame:
    """One row by sample: k, number of k-mers, smallest, largest and total count."""
    return counts.groupBy("sample_id").agg(F.lit(k).alias("k"), F.count("*").alias("total_kmers"), F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"), F.sum("cnt").alias("sum_count"))


def in_range(counts: DataFrame, low: int, high: int) -> DataFrame:
    return counts.where(F.col("cnt").between(low, high))


def sorted_store(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """``counts`` as a stored table, bucketed and sorted by (sample_id, kmer): a join on both reads it without a shuffle. The
    table is external, in the folder of this application's tables, and its name is known to this application alone."""
    spark = counts.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "sorted")
    name = "counts_" + path[-32:]
    by = ["sample_id", "kmer"]
    counts.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.table(name)


def lookup(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """``queries`` (sample_id, kmer) with cnt (0 where absent) and found."""
    met = queries.join(counts, ["sample_id", "kmer"], "left")
    return met.withColumn("found", F.col("cnt").isNotNull()).withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


_AT = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("read_no", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.LongType())])
_SUMS = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("read_no", T.LongType()), T.StructField("kmer", T.LongType()), T.StructField("n", T.LongType())])
_RUNS = T.StructType([T.StructField("read_no", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("len", T.LongType()), T.StructField("bin", T.LongType())])


def _dealt(reads: DataFrame, *columns: str) -> DataFrame:
    return spread(reads.select(*columns))  # groups leave null sequences out


def read_kmers(reads: DataFrame, k: int, invalid: str = "as_a") -> DataFrame:
    """(sample_id, read_no, pos, kmer): packed canonical k-mers of each read; null where a window has another character."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for samples, reads_, seqs in seq.groups(*(c.to_pylist() for c in batch.columns)):
                raw, starts, n = seq.joined(seqs)
                kmer, ok = seq.pack_windows(raw, k, invalid)
                at, which, pos = seq.windows_of(starts, n, k)
                yield pa.RecordBatch.from_arrays([pa.array(samples, pa.int32()).take(pa.array(which)), pa.array(reads_, pa.int64()).take(pa.array(which)), pa.array(pos.astype(np.int32)), pa.array(kmer[at], mask=~ok[at])], names=_AT.names)

    return _dealt(reads, "sample_id", "read_no", "seq").mapInArrow(positions, _AT)


def read_kmer_counts(reads: DataFrame, k: int, invalid: str = "as_a") -> DataFrame:
    """(sample_id, read_no, kmer, n): each k-mer of a read once, with its number; null for windows with another character."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for samples, reads_, seqs in seq.groups(*(c.to_pylist() for c in batch.columns)):
                raw, starts, n = seq.joined(seqs)
                kmer, ok = seq.pack_windows(raw, k, invalid)
                at, which, _ = seq.windows_of(starts, n, k)
                value = np.where(ok[at], kmer[at], -1)
                order = np.lexsort((value, which))
                value, which = value[order], which[order]
                first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (which[1:] != which[:-1]))[: len(value)])
                value, which, times = value[first], pa.array(which[first]), np.diff(first, append=len(order))
                yield pa.RecordBatch.from_arrays([pa.array(samples, pa.int32()).take(which), pa.array(reads_, pa.int64()).take(which), pa.array(value, mask=value < 0), pa.array(times.astype(np.int64))], names=_SUMS.names)

    return _dealt(reads, "sample_id", "read_no", "seq").mapInArrow(sums, _SUMS)


def _blocks(reads: DataFrame, k: int, least: int) -> DataFrame:
    """(block, sample_id, reads, seqs): reads with a window and of at least ``least`` characters in blocks of about ``BLOCK_BASES`` bases of one sample, stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int | None, tuple[list, list]] = {}
        size: Counter = Counter()

        def block(sample: int | None) -> pa.RecordBatch:
            nonlocal number
            number += 1
            size.pop(sample)
            reads_, seqs = held.pop(sample)
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([sample], pa.int32()), pa.array([reads_], pa.list_(pa.int64())), pa.array([seqs], pa.list_(pa.string()))], names=["block", "sample_id", "reads", "seqs"])

        for batch in batches:
            for sample, read, bases in zip(*(c.to_pylist() for c in batch.columns)):
                if bases is None or len(bases) < least or len(bases) < k and len(bases.encode()) < k:
                    continue
                own = held.setdefault(sample, ([], []))
                own[0].append(read)
                own[1].append(bases)
                size[sample] += len(bases)
                if size[sample] >= BLOCK_BASES:
                    yield block(sample)
                elif size.total() >= HELD_BASES:  # many samples: the largest go
                    for x, _ in size.most_common(max(1, len(size) // 2)):
                        yield block(x)
        for sample in list(held):
            yield block(sample)

    return stored(_dealt(reads, "sample_id", "read_no", "seq").mapInArrow(pack, "block long, sample_id int, reads array<long>, seqs array<string>"), "read_blocks")


def by_blocks(reads: DataFrame, k: int, find: Callable[[DataFrame], DataFrame], kernel: Callable[..., pa.Array], value: str, *, least: int = 0, invalid: str = "as_a") -> DataFrame:
    """(sample_id, read_no, value) of each read with a window, by what ``find`` gives for the k-mers of its block.

    A block asks once for each of its distinct k-mers: ``find`` gets (block, sample_id, kmer) and returns (block, kmer, x, a long) of those it knows.
    ``kernel`` gets x of all windows of some reads, 0 if unknown, and the first window of each read and behind the last one, and returns a value for each read.
    """
    blocks = _blocks(reads, k, least)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts = []
                for (seqs,) in seq.groups(row["seqs"]):
                    kmer, ok = seq.pack_windows(seq.joined(seqs)[0], k, invalid)
                    parts.append(np.unique(kmer[ok]))
                kmer = np.unique(np.concatenate(parts))
                for j in range(0, len(kmer), ASKED):
                    own = kmer[j : j + ASKED]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["block"])), pa.array([row["sample_id"]] * len(own), pa.int32()), pa.array(own)], names=["block", "sample_id", "kmer"])

    def answer(block: pa.Table, met: pa.Table) -> pa.Table:
        order = np.argsort(met.column("kmer").to_numpy())
        known, x = met.column("kmer").to_numpy()[order], met.column("x").to_numpy()[order]
        out = []
        for row in block.to_pylist():  # one
            for reads_, seqs in seq.groups(row["reads"], row["seqs"]):
                raw, starts, n = seq.joined(seqs)
                kmer, ok = seq.pack_windows(raw, k, invalid)
                at = seq.windows_of(starts, n, k)[0]
                kmer, ok = kmer[at], ok[at]
                got = np.zeros(len(at), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, kmer), len(known) - 1)
                    ok &= known[place] == kmer
                    got[ok] = x[place[ok]]
                bounds = np.concatenate([[0], np.cumsum(n - k + 1)])
                out.append(pa.table([pa.array([row["sample_id"]] * len(n), pa.int32()), pa.array(reads_, pa.int64()), kernel(got, bounds)], names=["sample_id", "read_no", "value"]))
        return pa.concat_tables(out)

    asked = blocks.select("block", "sample_id", "seqs").mapInArrow(ask, "block long, sample_id int, kmer long")
    found = find(asked).select("block", "kmer", "x")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(answer, f"sample_id int, read_no long, value {value}")


def counters_for_reads(reads: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(sample_id, read_no, counters) of each read with a k-mer: the sample's count of each k-mer in order, 0 where absent or invalid."""
    find = lambda asked: asked.join(counts, ["sample_id", "kmer"]).select("block", "kmer", F.col("cnt").alias("x"))
    lists = lambda x, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x))
    return by_blocks(reads, k, find, lists, "array<long>", invalid="skip").withColumnRenamed("value", "counters")


def super_kmers(reads: DataFrame, k: int, m: int) -> DataFrame:
    """(read_no, start, len, bin): runs of neighbouring k-mers of a read with one signature; other characters break runs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seq.signature_table(m)
        for batch in batches:
            for reads_, seqs in seq.groups(*(c.to_pylist() for c in batch.columns)):
                raw, starts, _ = seq.joined(seqs)
                first, n, low = seq.signature_runs(raw, k, m, table)
                which = np.searchsorted(starts, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(reads_, pa.int64()).take(pa.array(which)), pa.array((first - starts[which]).astype(np.int32)), pa.array(n + k - 1), pa.array(low)], names=_RUNS.names)

    return _dealt(reads, "read_no", "seq").mapInArrow(runs, _RUNS)
