"""Sorted k-mer databases (pairs of a prefix and a suffix file) as a Python data source and sink.

The prefix file has a table of the first record of each prefix, the suffix file records of one width in that order. A scan is cut into ranges of
records; each task finds the prefixes of its range by binary search in the table and reads its own bytes of both files alone. Comparisons
of ``cnt`` and ``kmer`` with constants are pushed into the scan: counts are compared before rows are made, and in a sorted database (the plain version)
a bound on k-mers narrows the ranges through the table, so a point lookup reads one prefix's records. A path is a pair, named without extension, or a folder of pairs.

The sink writes a pair for each sorted partition. Tasks write under a temporary folder; the commit moves the pairs of the tasks that
succeeded, an abort deletes the folder.

Fixed values of the format: markers, header layout and offsets.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .places import files_of, open_file, split

MARK_PREFIX, MARK_SUFFIX = b"KMCP", b"KMCS"
VERSION_PLAIN, VERSION_SIGNATURES = 0, 0x200
FIELDS = T.StructType([T.StructField("kmer", T.LongType()), T.StructField("cnt", T.LongType())])
#: records of a task, and of a batch
RANGE, BATCH = 4_000_000, 200_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ARROW = pa.schema([("kmer", pa.int64()), ("cnt", pa.int64())])


def _fields(tail: bytes, size: int) -> dict:
    """Header fields from the last bytes of a prefix file of ``size`` bytes."""
    if tail[-4:] != MARK_PREFIX:
        raise ValueError("not a k-mer database")
    version = struct.unpack_from("<I", tail, len(tail) - 12)[0]
    if version not in (VERSION_PLAIN, VERSION_SIGNATURES):
        raise ValueError(f"unknown version {version:#x}")
    length = struct.unpack_from("<I", tail, len(tail) - 8)[0]
    at = len(tail) - 8 - length
    if version == VERSION_PLAIN:
        k, mode, counter, prefix, low, high_lo, total = struct.unpack_from("<IIIIIIQ", tail, at)
        strand, high_hi = struct.unpack_from("<?3xI", tail, at + 32)
        signature = 0
        high = high_lo | high_hi << 32
    else:
        k, mode, counter, prefix, signature, low, high, total, strand = struct.unpack_from("<IIIIIIIQ?", tail, at)
    return {"k": k, "mode": mode, "counter_size": counter, "lut_prefix_length": prefix, "signature_length": signature, "min_count": low, "max_count": high, "both_strands": not strand, "total_kmers": total, "version": version, "header_at": size - 8 - length}


def header(pre: bytes) -> dict:
    """Header fields of a prefix file; raises ValueError if a marker is missing or the version unknown."""
    if pre[:4] != MARK_PREFIX:
        raise ValueError("not a k-mer database")
    return _fields(pre, len(pre))


class Database:
    """An open pair. ``first(c)`` is the first record of cell ``c`` of the prefix table; a database with signatures has a table for each bin, one after another."""

    def __init__(self, path: str):
        self.pre, self.suf = open_file(path + ".kmc_pre"), open_file(path + ".kmc_suf")
        size = self.pre.size()
        if self.pre.read_at(4, 0) != MARK_PREFIX or self.suf.read_at(4, 0) != MARK_SUFFIX or self.suf.read_at(4, self.suf.size() - 4) != MARK_SUFFIX:
            raise ValueError("not a k-mer database")
        self.header = h = _fields(self.pre.read_at(min(size, 512), max(0, size - 512)), size)
        if h["k"] > 31:
            raise ValueError("k-mers of more than 31 bases don't fit a long")
        self.total, self.bases, self.prefixes = h["total_kmers"], h["k"] - h["lut_prefix_length"], 4 ** h["lut_prefix_length"]
        end = h["header_at"] - (4 * (4 ** h["signature_length"] + 1) if h["version"] else 0)
        self.cells = (end - 4) // 8 // self.prefixes * self.prefixes  # a last entry may repeat the total
        self.width = self.bases // 4
        self.record = self.width + h["counter_size"]

    def firsts(self, begin: int, end: int) -> np.ndarray:
        """First records of cells from ``begin`` up to and with ``end``; of what is behind the last cell, the total."""
        got = np.frombuffer(self.pre.read_at(8 * (min(end + 1, self.cells) - begin), 4 + 8 * begin), "<u8").astype(np.int64)
        return np.append(got, self.total) if end >= self.cells else got

    def cell_of(self, record: int) -> int:
        """The last cell that begins at or before a record."""
        low, high = 0, self.cells
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if int(self.firsts(mid, mid)[0]) <= record else (low, mid)
        return low

    def narrowed(self, low: int, high: int) -> tuple[int, int]:
        """Records that can hold k-mers from ``low`` to ``high``."""
        if self.header["version"] != VERSION_PLAIN or self.cells != self.prefixes:
            return 0, self.total
        a, b = max(0, low) >> 2 * self.bases, min(high, 4 ** self.header["k"] - 1) >> 2 * self.bases
        return (int(self.firsts(a, a)[0]), int(self.firsts(b + 1, b + 1)[-1])) if 0 <= a <= b < self.cells else (0, 0)

    def batches(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(k-mers, counts) of the records from ``start`` to ``end``, in file order."""
        for a in range(start, end, BATCH):
            b = min(end, a + BATCH)
            c0, c1 = self.cell_of(a), self.cell_of(b - 1)
            firsts = np.clip(self.firsts(c0, c1 + 1), a, b)
            prefix = np.repeat(np.arange(c0, c1 + 1, dtype=np.int64) % self.prefixes, np.diff(firsts))
            raw = np.frombuffer(self.suf.read_at((b - a) * self.record, 4 + a * self.record), np.uint8).reshape(b - a, self.record)
            kmer = prefix
            for k in range(self.width):
                kmer = kmer << 8 | raw[:, k]
            cnt = np.ones(b - a, np.int64)
            if self.header["mode"]:
                cnt = np.ascontiguousarray(raw[:, self.width : self.width + 4]).view("<f4").ravel().astype(np.int64)
            elif self.header["counter_size"]:
                cnt = sum(raw[:, self.width + k].astype(np.int64) << 8 * k for k in range(self.header["counter_size"]))
            yield kmer, cnt


def build(counts: dict[int, int], k: int, prefix: int, counter_size: int = 4, low: int = 1, high: int = 2**32 - 1, both_strands: bool = True) -> tuple[bytes, bytes]:
    """Bytes of a plain database of packed k-mers; ``k - prefix`` must be a multiple of 4."""
    keys = sorted(counts)
    packer = _Packer(k, prefix, counter_size)
    body = packer.body(np.array(keys, np.int64), np.array([counts[x] for x in keys], np.int64))
    return packer.prefix_file(low, high, both_strands), MARK_SUFFIX + body + MARK_SUFFIX


class _Packer:
    """Bytes of a plain database, k-mers in order; holds the prefix table alone."""

    def __init__(self, k: int, prefix: int, counter_size: int):
        if (k - prefix) % 4:
            raise ValueError("k - prefix must be a multiple of 4")
        self.k, self.lut, self.size = k, prefix, counter_size
        self.cells, self.total, self.last = np.zeros(4**prefix, np.int64), 0, -1

    def body(self, kmer: np.ndarray, cnt: np.ndarray) -> bytes:
        if len(kmer) and (kmer[0] <= self.last or (np.diff(kmer) <= 0).any()):
            raise ValueError("k-mers must be distinct and sorted")
        bases, m = self.k - self.lut, len(kmer)
        if m:
            self.last = int(kmer[-1])
        self.total += m
        self.cells += np.bincount(kmer >> 2 * bases, minlength=len(self.cells))
        raw = np.empty((m, bases // 4 + self.size), np.uint8)
        for j in range(bases // 4):
            raw[:, j] = kmer >> 2 * bases - 8 * (j + 1) & 255
        for j in range(self.size):
            raw[:, bases // 4 + j] = cnt >> 8 * j & 255
        return raw.tobytes()

    def prefix_file(self, low: int, high: int, both_strands: bool) -> bytes:
        head = struct.pack("<IIIIIIQ", self.k, 0, self.size, self.lut, low, high & 0xFFFFFFFF, self.total) + struct.pack("<?3xI", not both_strands, high >> 32) + struct.pack("<I", VERSION_PLAIN)
        starts = np.cumsum(self.cells) - self.cells
        return MARK_PREFIX + starts.astype("<u8").tobytes() + head + struct.pack("<I", len(head)) + MARK_PREFIX


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        number = lambda n, other: int(options[n]) if n in options else other
        self.bounds = {"cnt": [number("min_count", LOWEST), number("max_count", HIGHEST)], "kmer": [LOWEST, HIGHEST]}
        self.records = number("records", RANGE)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.bounds:
                continue  # neither is ever null
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else ""
            if name not in self.bounds or not isinstance(f.value, int):
                yield f
                continue
            bound = self.bounds[name]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                bound[0] = max(bound[0], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound[1] = min(bound[1], f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Range]:
        out = []
        for path in pairs(self.options["path"]):
            start, end = Database(path).narrowed(*self.bounds["kmer"])
            out += [Range(path, a, min(end, a + self.records)) for a in range(start, end, self.records)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        db = Database(partition.path)
        (low, high), (first, last) = self.bounds["cnt"], self.bounds["kmer"]
        low, high = max(low, db.header["min_count"]), min(high, db.header["max_count"])
        for kmer, cnt in db.batches(partition.start, partition.end):
            fit = (cnt >= low) & (cnt <= high) & (kmer >= first) & (kmer <= last)
            yield pa.RecordBatch.from_arrays([pa.array(kmer[fit]), pa.array(cnt[fit])], schema=_ARROW)


def pairs(path: str) -> list[str]:
    """The pairs of a folder, or the one pair of this name, without extension."""
    system, p = split(path)
    return [f.removesuffix(".kmc_pre") for f in files_of(path) if f.endswith(".kmc_pre")] if system.get_file_info(p).type == fs.FileType.Directory else [path]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]
    total: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, f"_temporary-{uuid.uuid4().hex}"
        self.k, self.prefix, self.size = int(options["k"]), int(options["prefix"]), int(options.get("counter_size", 4))
        self.both = options.get("both_strands", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, p = split(self.path)
        packer, name, stream, low, high = _Packer(self.k, self.prefix, self.size), None, None, HIGHEST, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            kmer, cnt = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("kmer", "cnt"))
            if stream is None:
                c = TaskContext.get()
                name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}"
                system.create_dir(f"{p}/{self.job}", recursive=True)
                stream = system.open_output_stream(f"{p}/{self.job}/{name}.kmc_suf")
                stream.write(MARK_SUFFIX)
            most = (1 << 8 * self.size) - 1
            cnt = np.minimum(cnt, most)
            low, high = min(low, int(cnt.min())), max(high, int(cnt.max()))
            stream.write(packer.body(kmer, cnt))
        if stream is None:
            return Written((), 0)
        stream.write(MARK_SUFFIX)
        stream.close()
        with system.open_output_stream(f"{p}/{self.job}/{name}.kmc_pre") as f:
            f.write(packer.prefix_file(low, high, self.both))
        return Written((name,), packer.total)

    def commit(self, messages: list[Written | None]) -> None:
        system, p = split(self.path)
        if self.overwrite:
            for old in pairs(self.path) if system.get_file_info(p).type == fs.FileType.Directory else []:
                for end in (".kmc_pre", ".kmc_suf"):
                    system.delete_file(split(old + end)[1])
        for m in messages:
            for name in m.names if m else ():
                for end in (".kmc_suf", ".kmc_pre"):  # a pair is seen by its prefix file
                    system.move(f"{p}/{self.job}/{name}{end}", f"{p}/{name}{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, p = split(self.path)
        if system.get_file_info(f"{p}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{p}/{self.job}")


class KmerDbSource(DataSource):
    """Options: path, min_count, max_count, records (of a task); to write also k, prefix, counter_size, both_strands."""

    @classmethod
    def name(cls) -> str:
        return "kmerdb"

    def schema(self):
        return FIELDS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(KmerDbSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_kmerdb(spark, path: str, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("kmerdb").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def prefix_length(k: int) -> int:
    """A prefix that leaves whole bytes, of at most seven bases."""
    return k % 4 + 4 if k % 4 + 4 < k else k % 4


def write_kmerdb(counts: DataFrame, path: str, k: int, *, prefix: int | None = None, counter_size: int = 4, files: int | None = None, mode: str = "overwrite") -> None:
    """(kmer, cnt) of distinct packed k-mers as a folder of pairs: each partition of ``counts`` sorted as it is, or ``files`` pairs
    of a range of k-mers each. A pair's prefix table tells which of its records a range of k-mers needs, so either reads alike."""
    register(counts.sparkSession)
    rows = counts.select("kmer", "cnt")
    sorted_ = (rows.repartitionByRange(files, "kmer") if files else rows).sortWithinPartitions("kmer")
    sorted_.write.format("kmerdb").options(k=k, prefix=prefix_length(k) if prefix is None else prefix, counter_size=counter_size).mode(mode).save(path)
