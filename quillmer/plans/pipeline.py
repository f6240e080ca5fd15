"""The cohort pipeline: count, matrix, cluster, extract. Each stage's tables stand in the work folder, so a run may begin at any stage.

K counts k-mers by sample; B numbers features, keeps those that aren't rare and normalises their vectors; C clusters
the vectors; E tests clusters, classes their k-mers and extracts the reads that vote for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import cluster as clustering
from ..operators import counts as C
from ..operators import extract as X
from ..operators import matrix as M
from ..operators import ranks as R
from ..params import Params
from ..sources import files
from ..storage import stored

STAGES = "KBCE"


@dataclass
class Pipeline:
    """``manifest`` is (sample_id, grp, ...), one row per sample, group A first; ``reads`` holds all samples' reads."""

    spark: SparkSession
    reads: DataFrame
    manifest: DataFrame
    work: str
    params: Params = Params()

    def __post_init__(self) -> None:
        rows = self.manifest.select("sample_id", "grp").orderBy("sample_id").collect()  # a row per sample
        self.samples = [r.sample_id for r in rows]
        self.n1 = sum(r.grp == "A" for r in rows)
        self.n2 = len(rows) - self.n1
        self.groups = self.manifest.select("sample_id", "grp")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, f"{self.work}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.work}/{name}")

    def count(self) -> None:
        p = self.params
        self._write(C.count_kmers(self.reads, p.k, min_count=p.min_count, max_count=p.max_count, invalid=p.invalid, samples=len(self.samples)), "counts")

    def matrix(self) -> None:
        p, counts = self.params, self.table("counts")
        features = self._write(C.features(counts), "features")
        stats = self._write(C.sample_stats(counts), "sample_stats")
        offsets = {r.sample_id: r.offset for r in stats.collect()}  # a row per sample
        frequent = counts.join(M.rarity_filter(counts, len(self.samples), p.rarity).select("kmer"), "kmer", "left_semi")
        vectors = M.lognorm(M.dense(frequent, self.samples), offsets, self.samples).join(features, "kmer")
        self._write(vectors.select(F.col("feature_id").alias("cluster_id"), "values", F.lit(1).cast("long").alias("n")), "vectors")

    def cluster(self) -> None:
        p, start = self.params, self.table("vectors")
        members = None
        if p.warm_up_rounds:
            start, members = clustering.cluster(start, len(self.samples), min_similarity=p.start_similarity, iterations=p.warm_up_rounds, bucket_threshold=p.bucket_threshold, seed=p.seed + 7919)
        clusters, moved = clustering.cluster(start, len(self.samples), min_similarity=p.min_similarity, iterations=p.iterations, bucket_threshold=p.bucket_threshold, seed=p.seed)
        if members is not None:
            moved = members.join(moved.select(F.col("feature_id").alias("cluster_id"), F.col("cluster_id").alias("new")), "cluster_id").select("feature_id", F.col("new").alias("cluster_id"))
        kept = self._write(clusters.where(F.col("n") > p.ignore_small), "clusters")
        self._write(moved.join(kept.select("cluster_id"), "cluster_id", "left_semi"), "members")

    def classes(self) -> DataFrame:
        """(kmer, grp) of the clusters that differ; a k-mer in both classes is A's."""
        p = self.params
        tested = self._write(clustering.test_clusters(self.table("clusters"), self.n1, self.n2, p=p.p_value, size_threshold=p.size_threshold, test=p.test), "tested")
        marked = self.table("members").join(tested.where("grp IS NOT NULL").select("cluster_id", "grp"), "cluster_id").join(self.table("features"), "feature_id")
        return self._write(marked.groupBy("kmer").agg(F.min("grp").alias("grp")), "classes")

    def extract(self) -> DataFrame:
        kept = X.extract(self.reads, self.groups, self.classes(), self.params.k, self.params.vote)
        return self._write(kept, "extracted")

    def run(self, start: str = "K", only: bool = False) -> DataFrame | None:
        """From stage ``start`` on, or that stage alone; the extracted reads, if stage E ran."""
        at = STAGES.index(start)
        out = None
        for stage in STAGES[at : at + 1] if only else STAGES[at:]:
            out = {"K": self.count, "B": self.matrix, "C": self.cluster, "E": self.extract}[stage]()
        return out

    def per_feature(self) -> DataFrame:
        """The variant without clusters: each k-mer's frequencies per million, present in enough samples, by the rank test;
        (kmer, grp, large). Group ids decide the order of values, A first."""
        counts = self.table("counts")
        coverage = {r["sample_id"]: r["coverage"] for r in C.sample_stats(counts).collect()}  # a row per sample
        n = len(self.samples)
        wide = M.frequencies(counts, coverage, self.samples[: self.n1], self.samples[self.n1 :])
        tested = R.mann_whitney(wide.where(F.col("zeros") < 0.7 * n), self.n1, self.n2)
        return self._write(tested.select("kmer", M.classify(F.col("p_left"), F.col("p_right"), self.params.p_value).alias("grp"), (F.col("total") > 2 * n).alias("large")), "per_feature")

    def write_outputs(self, prefix: str) -> None:
        """Text forms: members, centroids, classed k-mers and the extracted reads as FASTQ by group and sample."""
        files.write_members(self.table("members"), f"{prefix}/members", self.params.ignore_small)
        files.write_matrix(self.table("clusters"), f"{prefix}/centroids")
        self.table("classes").select(F.concat_ws("\t", seq.decode(F.col("kmer"), self.params.k), "grp").alias("value")).write.mode("overwrite").text(f"{prefix}/classes")
        files.write_fastq(self.table("extracted").withColumn("sample", F.col("sample_id").cast("string")), f"{prefix}/reads")


def cluster_matrix(spark: SparkSession, path: str, *, l2: bool = False, **args) -> tuple[DataFrame, DataFrame]:
    """Clusters and members of a text matrix: a line is a feature."""
    rows = files.read_matrix(spark, path, l2)
    first = rows.select(F.size("values")).first()
    vectors = rows.select(F.col("feature_id").alias("cluster_id"), "values", F.lit(1).cast("long").alias("n"))
    return clustering.cluster(vectors, first[0] if first else 0, **args)
