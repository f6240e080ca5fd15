"""Tables between stages: written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the checkpoint folder set by hand. A local master may go without and gets a
    folder of its own; on a cluster the executors wouldn't see such a folder, so that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmer-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_folders: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables, which goes when the application ends."""
    path = f"{shared_dir(spark)}/quillmer/{spark.sparkContext.applicationId}"
    if path not in _folders:
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders.add(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, which cuts its lineage and survives lost executors; and where it lies."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`materialize` once nothing reads them any more."""
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    return materialize(df, tag, path)[0]


def with_dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids 0, 1, ... in the order of a unique key, without a global window: range partitions, then an offset for each."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = stored(df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_m", 33)
    sizes = local.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).orderBy("_p").collect()  # a row per partition
    rows, at = [], 0
    for r in sizes:
        rows.append((r["_p"], at))
        at += r["_n"]
    offsets = spark.createDataFrame(rows, "_p long, _o long")
    return local.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_o", "_m")


def scan_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` scans, by Spark's estimate: what comes after the scans, as a Python function, doesn't change it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions if its scan would have fewer partitions than there are cores: files that are few and small
    leave most cores idle. A larger scan isn't shuffled; what is moved is bounded by a scan partition for each core."""
    spark = df.sparkSession
    n, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return df.repartition(n) if n > 1 and scan_bytes(df) < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df
