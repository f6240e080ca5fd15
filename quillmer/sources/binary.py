"""Binary files of fixed-width rows, and clusters as pairs of a binary and a text file.

``binaryrows`` reads rows of ``width`` numbers of one type: dictionaries (one long a row), count columns, centroids. A task reads the bytes of its range of
rows alone; ``start`` and ``num``, and comparisons of ``row_id`` with constants, narrow what is read at all.

``clusterpair`` writes clusters of more than ``ignore_small`` members in order of their ids: 32-bit floats of each centroid (``.bin``), a line ``size id id ...`` by
cluster (``.clust``) and, so that lines can be found without reading those before, their byte offsets (``.idx``). The rows of both files correspond by position. Members come one by one, so no cluster is
held in memory. Tasks write under a temporary folder; the commit moves the parts of the tasks that succeeded, an abort deletes the folder. A window
of clusters reads its own bytes of all three files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .places import files_of, open_file, split

#: rows of a task; members of a batch
RANGE, BATCH = 1_000_000, 200_000
ROWS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
MEMBERS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("feature_id", T.LongType())])
_ROWS, _MEMBERS = pa.schema([("row_id", pa.int64()), ("values", pa.list_(pa.float64()))]), pa.schema([("row_id", pa.int64()), ("feature_id", pa.int64())])


@dataclass
class Range(InputPartition):
    """Rows of a file from ``start`` to ``end``; the first row of the file is row ``base`` of all."""

    path: str
    base: int
    start: int
    end: int


class _Rows(DataSourceReader):
    """Ranges of rows of the files of a path, numbered through in the order of their names."""

    ending = ""

    def __init__(self, options: dict):
        self.path, self.kind, self.width, self.rows = options["path"], np.dtype(options.get("type", "<f4")), int(options.get("width", 1)), int(options.get("rows", RANGE))
        self.low = int(options.get("start", 0))
        self.high = self.low + int(options["num"]) - 1 if "num" in options else 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            own = getattr(f, "attribute", None) == ("row_id",)
            if own and isinstance(f, IsNotNull):
                continue
            if not own or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or not isinstance(f.value, int):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path in (p for p in files_of(self.path) if p.endswith(self.ending)):
            n = open_file(path).size() // (self.kind.itemsize * self.width)
            a, b = max(0, self.low - base), min(n, self.high + 1 - base)
            out += [Range(path, base, s, min(b, s + self.rows)) for s in range(a, b, self.rows)]
            base += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, size = partition, self.kind.itemsize * self.width
        if not p.path:
            return
        file, step = open_file(p.path), max(1, (1 << 22) // size)
        for a in range(p.start, p.end, step):
            b = min(p.end, a + step)
            x = np.frombuffer(file.read_at((b - a) * size, a * size), self.kind).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.base + a, p.base + b)), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * self.width), pa.array(x))], schema=_ROWS)


class BinaryRowsSource(DataSource):
    """Options: path (a file or a folder), type (as numpy writes it), width, start, num, rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "binaryrows"

    def schema(self):
        return ROWS

    def reader(self, schema) -> _Rows:
        return _Rows(dict(self.options))


class _Centroids(_Rows):
    ending = ".bin"


class _Members(_Rows):
    """Members by the lines' offsets: eight bytes for each line in the index."""

    ending = ".idx"

    def __init__(self, options: dict):
        super().__init__(options | {"type": "<u8", "width": 1})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.path:
            return
        text = open_file(p.path.removesuffix(".idx") + ".clust")
        at = np.frombuffer(open_file(p.path).read_at(8 * (p.end - p.start + 1), 8 * p.start), "<u8").astype(np.int64)
        row, rest, place = p.base + p.start, b"", int(at[0])
        end, first = int(at[p.end - p.start]) if len(at) > p.end - p.start else text.size(), True
        while place < end:  # lines may be longer than what is read at once
            piece = text.read_at(min(1 << 22, end - place), place)
            place += len(piece)
            lines = (rest + piece).split(b"\n")
            rows, ids = [], []
            for k, line in enumerate(lines):
                parts = line.split(b"\t")
                last = k == len(lines) - 1
                rest = parts.pop() if last else b""  # a number may be cut
                if first and parts:  # the size
                    parts, first = parts[1:], False
                ids += parts
                rows += [row] * len(parts)
                if not last:
                    row, first = row + 1, True
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.array(ids, np.int64))], schema=_MEMBERS)


@dataclass
class Written(WriterCommitMessage):
    name: str


class _PairWriter(DataSourceArrowWriter):
    """Rows (cluster_id, n, feature_id, values) in order: of each cluster a first one with its values, then one for each member."""

    ends = (".bin", ".clust", ".idx")

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, p = split(self.path)
        c = TaskContext.get()
        name, files, at, open_line = f"part-{c.partitionId():05d}-{c.taskAttemptId()}", None, 0, False
        for batch in iterator:
            if files is None and batch.num_rows:
                system.create_dir(f"{p}/{self.job}", recursive=True)
                files = [system.open_output_stream(f"{p}/{self.job}/{name}{end}") for end in self.ends]
            centre, line, offsets = [], [], []
            ns, features, values = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("n", "feature_id", "values"))
            for n, feature, v in zip(ns, features, values):
                if v is None:
                    line.append(f"\t{feature}")
                    at += len(line[-1])
                    continue
                line.append(f"\n{n}" if open_line else str(n))
                offsets.append(at + open_line)
                at += len(line[-1])
                open_line = True
                centre.append(np.array(v, "<f4").tobytes())
            if files:
                for f, data in zip(files, (b"".join(centre), "".join(line).encode(), np.array(offsets, "<u8").tobytes())):
                    f.write(data)
        if files:
            files[1].write(b"\n")
            for f in files:
                f.close()
        return Written(name if files else "")

    def commit(self, messages: list[Written | None]) -> None:
        system, p = split(self.path)
        if self.overwrite and system.get_file_info(p).type == fs.FileType.Directory:
            for old in files_of(self.path):
                if old.endswith(self.ends):
                    system.delete_file(split(old)[1])
        for m in messages:
            for end in self.ends if m and m.name else ():
                system.move(f"{p}/{self.job}/{m.name}{end}", f"{p}/{m.name}{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, p = split(self.path)
        if system.get_file_info(f"{p}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{p}/{self.job}")


class ClusterPairSource(DataSource):
    """Options: path, side (centroids or members), width (values of a centroid), start, num, rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "clusterpair"

    def schema(self):
        return ROWS if self.options.get("side", "centroids") == "centroids" else MEMBERS

    def reader(self, schema) -> _Rows:
        return (_Centroids if self.options.get("side", "centroids") == "centroids" else _Members)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _PairWriter:
        return _PairWriter(dict(self.options), overwrite)


def register(spark) -> None:
    for source in (BinaryRowsSource, ClusterPairSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_rows(spark, path: str, kind: str, width: int = 1, **options) -> DataFrame:
    """(row_id, values) of a file of rows of ``width`` numbers, or of a folder of such files."""
    register(spark)
    return spark.read.format("binaryrows").options(path=path, type=kind, width=width, **options).load()


def write_clusters(clusters: DataFrame, members: DataFrame, path: str, *, ignore_small: int = 5, files: int | None = None, mode: str = "overwrite") -> None:
    """``clusters`` (cluster_id, values, n) and ``members`` (cluster_id, feature_id) as pairs, each of a range of cluster ids."""
    register(clusters.sparkSession)
    kept = clusters.where(F.col("n") > ignore_small)
    none = F.lit(None)
    heads = kept.select("cluster_id", "n", none.cast("long").alias("feature_id"), F.col("values").cast("array<double>").alias("values"))
    own = members.join(kept.select("cluster_id", "n"), "cluster_id").select("cluster_id", "n", "feature_id", none.cast("array<double>").alias("values"))
    dealt = heads.unionByName(own).repartitionByRange(*([files] if files else []), "cluster_id").sortWithinPartitions("cluster_id", F.asc_nulls_first("feature_id"))
    dealt.write.format("clusterpair").mode(mode).save(path)


def read_clusters(spark, path: str, side: str, width: int, **options) -> DataFrame:
    """Centroids (row_id, values) or members (row_id, feature_id) of the clusters from ``start`` on, ``num`` of them, by their place in the files."""
    register(spark)
    return spark.read.format("clusterpair").options(path=path, side=side, width=width, **options).load()
