"""Adapters: any table of texts as reads of samples, any table of vectors as profiles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26]
#: samples below this number form group A in the adapted tables
GROUP_A = 10


_BASE_OF = bytes.maketrans(LETTERS.encode(), AS_BASES.encode())
_OTHER = bytes(set(range(256)) - set(LETTERS.encode()))


@F.arrow_udf(T.StringType())
def bases_of(texts: pa.Array) -> pa.Array:
    """Letters as bases in turn, upper case as lower case; other characters go, null is empty."""
    return pa.array([(t.as_py() or "").lower().encode().translate(_BASE_OF, _OTHER).decode() for t in texts], pa.string())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_reads(docs: DataFrame) -> DataFrame:
    """Documents as reads: the source's number is the sample, letters become bases in turn, other characters go."""
    return docs.select(F.substring("source", 4, 10).cast("int").alias("sample_id"), F.col("doc_id").alias("read_no"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), bases_of("text").alias("seq"), F.lit("").alias("qual"))


def group_of(sample_id: str = "sample_id"):
    return F.when(F.col(sample_id) < GROUP_A, "A").otherwise("B")
