"""The count matrix as a table in two levels of partitions, by sample and by range of features.

A slice of features for some samples reads its partitions alone. A sample that is counted again replaces its own partitions and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: features of a partition
SLICE = 1_000_000


def write_slices(counts: DataFrame, features: DataFrame, path: str, *, slice_rows: int = SLICE) -> None:
    """(sample_id, kmer, cnt) by feature; partitions that ``counts`` has rows for are replaced, others stay."""
    rows = counts.join(features, "kmer").select("sample_id", F.floor(F.col("feature_id") / slice_rows).alias("slice"), "feature_id", "cnt")
    # a task for each sample and range: no more than slice_rows rows, in a file of their own
    dealt = rows.repartition("sample_id", "slice").sortWithinPartitions("sample_id", "slice", "feature_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id", "slice").parquet(path)


def read_slice(spark: SparkSession, path: str, first: int, number: int, samples: list[int] | None = None, *, slice_rows: int = SLICE) -> DataFrame:
    """(sample_id, feature_id, cnt) of ``number`` features from ``first`` on, of all samples or of some; ``slice_rows`` as it was written."""
    last = first + number - 1
    rows = spark.read.schema("feature_id long, cnt long, sample_id int, slice long").parquet(path)
    some = rows.where(F.col("slice").between(first // slice_rows, last // slice_rows) & F.col("feature_id").between(first, last))
    return (some if samples is None else some.where(F.col("sample_id").isin(samples))).select("sample_id", "feature_id", "cnt")
