"""Streaming k-mer counts: reads as they come, counts by sample kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..schema import READS


def read_stream(spark, path: str) -> DataFrame:
    """Parquet files of reads, as they appear in a folder."""
    return spark.readStream.schema(READS).parquet(path)


def count_stream(reads: DataFrame, k: int, *, invalid: str = "skip", min_count: int = 1, max_count: int = 65535) -> DataFrame:
    """(sample_id, kmer, cnt) so far; for output mode update or complete. Batches combine their own counts first."""
    partial = seq.count_in_batches(reads, k, invalid=invalid)
    total = partial.groupBy("sample_id", "kmer").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= min_count)
    return total.withColumn("cnt", F.least("cnt", F.lit(max_count).cast("long")))
