"""File sources and sinks: manifests, text matrices, cluster files, FASTQ output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _in_order() -> Column:
    """Key of a line's place: file, split of the file, place in it. Splits are read in any order, large ones first."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def read_manifest(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """Two manifests (path and db name by line, white space between) as one; sample ids go on from A to B. Blank lines are left out."""
    rows = []
    for grp, path in (("A", path_a), ("B", path_b)):
        parts = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path, wholetext=False).where(F.trim("value") != "")
        got = lines.select(parts[0].alias("path"), F.get(parts, F.lit(1)).alias("db"), _in_order().alias("at")).orderBy("at").collect()  # a row per sample
        rows += [(grp, r["path"], r["db"]) for r in got]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id int, grp string, path string, db string")


def read_matrix(spark: SparkSession, path: str, l2: bool = False) -> DataFrame:
    """feature_id (line number among the data lines, from 0) and values; lines that are empty or begin with # or a tab are left out."""
    from ..functions.vectors import l2_normalise
    from ..storage import with_dense_ids

    lines = spark.read.text(path).select("value", _in_order().alias("at")).where("value <> '' AND value NOT LIKE '#%' AND substr(value, 1, 1) <> '\t'")
    numbered = with_dense_ids(lines, "at", "feature_id")
    values = F.transform(F.filter(F.split("value", r"[\t ]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    out = numbered.select("feature_id", values.alias("values"))
    return out.withColumn("values", l2_normalise(F.col("values"))) if l2 else out


def write_matrix(clusters: DataFrame, path: str, ignore_small: int = 0, mode: str = "overwrite") -> None:
    """Values of each cluster of more than ``ignore_small`` members, tab-separated."""
    text = F.array_join(F.transform("values", lambda x: x.cast("string")), "\t")
    clusters.where(F.col("n") > ignore_small).sort("cluster_id").select(text.alias("value")).write.mode(mode).text(path)


def write_members(members: DataFrame, path: str, ignore_small: int = 5, mode: str = "overwrite") -> None:
    """``size id id ...`` by cluster, tab-separated. The long table (cluster_id, feature_id) is the working form; this text
    form gathers a cluster's ids in one line, as its readers expect."""
    lines = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("feature_id")).alias("ids")).where(F.col("n") > ignore_small)
    lines.sort("cluster_id").select(F.concat_ws("\t", F.col("n").cast("string"), F.array_join(F.transform("ids", lambda x: x.cast("string")), "\t")).alias("value")).write.mode(mode).text(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, feature_id) from ``write_members`` lines; the cluster id is the smallest member's."""
    ids = F.transform(F.filter(F.split("value", "\t"), lambda x, i: i > 0), lambda x: x.cast("long"))
    return spark.read.text(path).select(ids.alias("ids")).select(F.array_min("ids").alias("cluster_id"), F.explode("ids").alias("feature_id"))


def fastq_lines() -> Column:
    """A row of reads as the text of its four lines; a read without qualities has an empty fourth line."""
    name = F.when(F.col("name").startswith("@"), F.col("name")).otherwise(F.concat(F.lit("@"), F.col("name")))
    return F.concat(name, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.coalesce("qual", F.lit("")))


def write_fastq(reads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reads (grp, sample, name, seq, qual) as text, a folder by group and sample."""
    reads.select("grp", "sample", fastq_lines().alias("value")).write.mode(mode).partitionBy("grp", "sample").text(path)
