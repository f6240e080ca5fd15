"""Extraction: reads whose k-mers vote for a set of k-mers; and genomes quantified by clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .counts import by_blocks

#: k-mers of a set (16 bytes each) up to which it is broadcast; beyond, the join shuffles
MAX_BROADCAST_KMERS = 2_000_000


def checked(marked: DataFrame) -> DataFrame:
    marked = stored(marked, "marked")
    return F.broadcast(marked) if marked.count() <= MAX_BROADCAST_KMERS else marked


def _hits(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Number of windows and of marked ones of each read."""
    total = np.concatenate([[0], np.cumsum(x)])
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds]))], names=["n", "hits"])


def _voted(reads: DataFrame, find, k: int, invalid: str) -> DataFrame:
    """(sample_id, read_no, n_kmers, hits, ratio), repeated reads together."""
    each = by_blocks(reads, k, find, _hits, "struct<n:long, hits:long>", least=k + 10, invalid=invalid)
    return each.groupBy("sample_id", "read_no").agg(F.sum("value.n").alias("n_kmers"), F.sum("value.hits").alias("hits")).withColumn("ratio", F.col("hits") / F.col("n_kmers"))


def votes(reads: DataFrame, marked: DataFrame, k: int, *, invalid: str = "as_a") -> DataFrame:
    """(sample_id, read_no, n_kmers, hits, ratio) of reads of at least k + 10 bases; ``marked`` holds distinct kmer."""
    few = checked(marked.select("kmer", F.lit(1).cast("long").alias("x")))
    return _voted(reads, lambda asked: asked.join(few, "kmer"), k, invalid)


def thin(voted: DataFrame, reads: DataFrame, large: DataFrame, k: int, *, seed: int = 1, invalid: str = "as_a") -> DataFrame:
    """Optional thinning of ``voted`` (sample_id, read_no, hits) reads: the more of a read's hits are k-mers of ``large``, the
    likelier it goes. It stays if a number from 0 to 1, hashed from the read, is above (0.5 + large hits) / hits."""
    heavy = votes(reads, large, k, invalid=invalid).select("sample_id", "read_no", F.col("hits").alias("large_hits"))
    number = F.pmod(F.xxhash64(F.lit(seed), "sample_id", "read_no"), F.lit(1 << 40)) / float(1 << 40)
    return voted.join(heavy, ["sample_id", "read_no"], "left").where(number > (0.5 + F.coalesce("large_hits", F.lit(0))) / F.col("hits")).drop("large_hits")


def extract(reads: DataFrame, groups: DataFrame, classes: DataFrame, k: int, vote: float = 0.5) -> DataFrame:
    """Reads of group A that vote for A's k-mers and reads of B that vote for B's: ``reads`` with grp.

    ``groups`` is (sample_id, grp), ``classes`` (kmer, grp), one grp per k-mer. A ratio must be above ``vote``.
    """
    known = reads.join(F.broadcast(groups), "sample_id")  # a row per sample
    few = checked(classes.select("kmer", "grp", F.lit(1).cast("long").alias("x")))
    won = _voted(reads.join(F.broadcast(groups.select("sample_id")), "sample_id"), lambda asked: asked.join(F.broadcast(groups), "sample_id").join(few, ["kmer", "grp"]), k, "as_a").where(F.col("ratio") > vote)
    return known.join(won.select("sample_id", "read_no"), ["sample_id", "read_no"], "left_semi")


def genome_quant(members: DataFrame, features: DataFrame, genome_kmers: DataFrame) -> DataFrame:
    """(genome, cluster_id, shared): distinct k-mers that a genome shares with a cluster."""
    clustered = members.join(features, "feature_id").select("cluster_id", "kmer")
    return genome_kmers.select("genome", "kmer").distinct().join(clustered, "kmer").groupBy("genome", "cluster_id").agg(F.count("*").alias("shared"))
