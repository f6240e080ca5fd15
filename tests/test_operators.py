"""Operators, sources, the pipeline on planted signals; round trips."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmer.operators import cluster as clustering
from quillmer.operators import counts as C
from quillmer.operators import extract as X
from quillmer.operators import matrix as M
from quillmer.operators import ranks as R
from quillmer.params import Params
from quillmer.plans.pipeline import Pipeline, cluster_matrix
from quillmer.schema import READS
from quillmer.sources import files, kmerdb
from quillmer.sources.fastx import read_fastx, records
from quillmer.storage import spread
from quillmer.streaming.kmers import count_stream, read_stream
from tests.test_functions import revcomp, seq_number


def reads_of(spark, rows):
    return spark.createDataFrame([(s, i, f"r{i}", q, "I" * len(q) if q else q) for i, (s, q) in enumerate(rows)], READS)


def test_counts_by_hand(spark):
    reads = reads_of(spark, [(0, "ACGNACG"), (0, "acg"), (1, "CGT"), (2, None), (2, "AC")])
    got = {(r.sample_id, r.kmer): r.cnt for r in C.count_kmers(reads, 3, min_count=1).collect()}
    assert got == {(0, seq_number("ACG")): 3, (1, seq_number("ACG")): 1}
    assert C.count_kmers(reads, 3).count() == 1 and C.count_kmers(reads.where("false"), 3).count() == 0
    assert C.count_kmers(reads, 3, min_count=1, max_count=2).agg(F.max("cnt")).first()[0] == 2
    assert C.count_kmers(reads_of(spark, [(0, "ACNGT")]), 5, min_count=1, invalid="as_a").first().kmer == min(seq_number("ACAGT"), seq_number(revcomp("ACAGT")))


def test_feature_ids_are_ranks(spark):
    kmers = random.Random(1).sample(range(10**6), 500)
    got = C.features(spark.createDataFrame([(k % 3, k, 1) for k in kmers], "sample_id int, kmer long, cnt long")).orderBy("kmer").collect()
    assert [r.feature_id for r in got] == list(range(500)) and [r.kmer for r in got] == sorted(kmers)


def test_vote_boundaries(spark):
    k = 5
    good = "ACGTACGTACGTACGTACGTACGT"
    reads = reads_of(spark, [(0, good[:14]), (0, good[:15]), (0, "G" * 24)])
    marked = C.universe(C.count_kmers(reads.where("read_no < 2"), k, min_count=1))
    got = {r.read_no: r for r in X.votes(reads, marked, k).collect()}
    assert set(got) == {1, 2} and got[1].ratio == 1.0 and got[2].hits == 0 and got[1].n_kmers == 11
    classes = marked.withColumn("grp", F.lit("A"))
    groups = spark.createDataFrame([(0, "A")], "sample_id int, grp string")
    assert [r.read_no for r in X.extract(reads, groups, classes, k, 0.5).collect()] == [1]
    assert X.extract(reads, groups, classes, k, 1.0).count() == 0  # the ratio must be above the vote


def test_thinning_follows_large_hits(spark):
    reads = reads_of(spark, [(0, "ACGTTGCAACGGTTAACCGTAGCT")] * 400)
    marked = C.universe(C.count_kmers(reads, 5, min_count=1))
    voted = X.votes(reads, marked, 5)
    assert X.thin(voted, reads, marked, 5).count() == 0  # every hit is large: the bar is above 1
    light = X.thin(voted, reads, marked.where("false"), 5)
    assert 360 <= light.count() < 400 and light.columns == voted.columns  # the bar is 0.5 of 20 hits
    assert sorted(light.select("read_no").collect()) == sorted(X.thin(voted.repartition(3), reads, marked.where("false"), 5).select("read_no").collect())


def test_rarity_and_gates(spark):
    c = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 3, 50)], "sample_id int, kmer long, cnt long")
    assert [r.kmer for r in M.rarity_filter(c, 20).orderBy("kmer").collect()] == [2, 3]
    assert [r.kmer for r in M.large_count(c, 20).collect()] == [3] and M.zero_gate(c, 20).count() == 0


def test_schedule_and_greedy_order():
    assert clustering.schedule(0.8, 3) == pytest.approx([0.95, 0.90, 0.85])
    into, centroids, heads = clustering.greedy(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.9]]), np.ones(3), 0.6)
    assert into.tolist() == [0, 1, 0] and heads.tolist() == [0, 1]  # the first row that is near enough
    assert centroids[0].tolist() == [1.0, 0.45]
    into, _, _ = clustering.greedy(np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]), np.ones(3), 0.1)
    assert into.tolist() == [0, 1, 2]  # zero vectors merge with nothing
    _, c, _ = clustering.greedy(np.array([[2.0, 4.0], [8.0, 10.0]]), np.array([1, 2]), 0.5)
    assert c.tolist() == [[6.0, 8.0]]


@pytest.mark.parametrize("bucket_threshold", [1_000_000, 5])
def test_clusters_keep_all_members_for_any_partitioning(spark, bucket_threshold):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * 0.05 + np.eye(6)[i % 4]).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "cluster_id long, values array<double>, n long")
    results = []
    for parts in (1, 5):
        clusters, members = clustering.cluster(df.repartition(parts), 6, min_similarity=0.8, iterations=4, bucket_threshold=bucket_threshold)
        got = {r.cluster_id: r for r in clusters.collect()}
        of = {r.feature_id: r.cluster_id for r in members.collect()}
        assert set(of) == set(range(120)) and sum(r.n for r in got.values()) == 120
        for c, r in got.items():
            own = [rows[f][1] for f, x in of.items() if x == c]
            assert len(own) == r.n and min(f for f, x in of.items() if x == c) == c
            assert np.allclose(np.mean(own, axis=0), r["values"], atol=1e-9)
        results.append(of)
    assert results[0] == results[1] and len(set(results[0].values())) < 120


def test_similar_pairs_of_representatives(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(3, 300)] + [(1, [1.0, 0.01, 0.0]), (2, [0.0, 0.0, 1.0])]
    got = clustering.similar_pairs(spark.createDataFrame(rows, "id long, values array<double>"), np.eye(3), 0.9).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 3)]


def test_small_scans_are_dealt_out(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4


def test_rank_tests_by_hand(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [6.0, 7.0, 8.0, 9.0, 10.0]), ([1.0] * 5, [1.0] * 5)], "a array<double>, b array<double>")
    got = R.mann_whitney(row, 5, 5).orderBy("u").collect()
    assert got[0].u == 0 and got[0].p_left < 0.01 and got[0].p_right == 0.25 and got[1].u == 12.5 and got[1].z == 0
    with pytest.raises(ValueError):
        R.mann_whitney(row, 4, 5)


FASTQ = "@r1 first\nACGT\nAC\n+\nIIII\n@I\n@r2\nGG\n+r2\n@@\n"


def test_fastx_forms(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    (tmp_path / "c.fa").write_text(">f1\nAC\nGT\n>f2 x\nTT\n")
    (tmp_path / "d.fq").write_text("@ok\nAC\n+\nII\n@cut\nACGT\n+\nII\n")
    (tmp_path / "e.fq").write_text("")
    got = read_fastx(spark, [str(tmp_path / n) for n in ("a.fq", "b.fq.gz", "c.fa", "d.fq", "e.fq")]).orderBy("sample_id", "read_no").collect()
    want = [("r1 first", "ACGTAC", "IIII@I"), ("r2", "GG", "@@")]
    assert [tuple(r)[2:] for r in got if r.sample_id in (0, 1)] == want * 2
    assert [tuple(r)[2:] for r in got if r.sample_id == 2] == [("f1", "ACGT", ""), ("f2 x", "TT", "")]
    assert [r.name for r in got if r.sample_id == 3] == ["ok"] and not [r for r in got if r.sample_id == 4]
    assert list(records(iter([]))) == []


def test_fastq_round_trip(spark, tmp_path):
    reads = reads_of(spark, [(0, "ACGT"), (0, "GG")]).withColumns({"grp": F.lit("A"), "sample": F.lit("s")})
    files.write_fastq(reads.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("grp=A/sample=s/part-*"))
    back = read_fastx(spark, [str(part)]).orderBy("read_no").collect()
    assert [(r.name, r.seq, r.qual) for r in back] == [("r0", "ACGT", "IIII"), ("r1", "GG", "II")]


def test_kmer_database_round_trip(spark, tmp_path):
    counts = {seq_number("".join(random.Random(i).choices("ACGT", k=9))): i % 7 + 1 for i in range(300)}
    pre, suf = kmerdb.build(counts, 9, 5)
    (tmp_path / "db.kmc_pre").write_bytes(pre)
    (tmp_path / "db.kmc_suf").write_bytes(suf)
    h = kmerdb.header(pre)
    assert (h["k"], h["total_kmers"], h["both_strands"], h["min_count"]) == (9, len(counts), True, 1)
    assert {r.kmer: r.cnt for r in kmerdb.read_kmerdb(spark, str(tmp_path / "db")).collect()} == counts
    assert {r.cnt for r in kmerdb.read_kmerdb(spark, str(tmp_path / "db"), min_count=3, max_count=4).collect()} == {3, 4}
    with pytest.raises(ValueError):
        kmerdb.header(b"nothing at all, really")


def test_text_forms(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\tname\n# note\n3 4\n\n0\t5\n")
    assert [r["values"] for r in files.read_matrix(spark, str(tmp_path / "m.txt"), l2=True).orderBy("feature_id").collect()] == [[0.6, 0.8], [0.0, 1.0]]
    members = spark.createDataFrame([(1, x) for x in range(1, 8)] + [(9, 9)], "cluster_id long, feature_id long")
    files.write_members(members, str(tmp_path / "members"))
    assert {(r.cluster_id, r.feature_id) for r in files.read_members(spark, str(tmp_path / "members")).collect()} == {(1, x) for x in range(1, 8)}
    (tmp_path / "a").write_text("x.fq dx\n\ny.fq dy\n")
    (tmp_path / "b").write_text("z.fq\tdz\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("sample_id").collect()] == [(0, "A", "x.fq", "dx"), (1, "A", "y.fq", "dy"), (2, "B", "z.fq", "dz")]
    clusters, members = cluster_matrix(spark, str(tmp_path / "m.txt"), iterations=2, min_similarity=0.5)
    assert members.count() == 2 and clusters.agg(F.sum("n")).first()[0] == 2


def test_planted_signal_end_to_end(spark, tmp_path):
    """A sequence that only one group holds: its reads are extracted from that group, and no others."""
    r = random.Random(4)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    planted, shared = {"A": dna(150), "B": dna(150)}, [dna(150) for _ in range(4)]
    rows = []
    for s in range(12):
        for x in shared:
            rows += [(s, x)] * r.randint(3, 5)
        own = planted["A" if s < 6 else "B"]
        rows += [(s, own[i : i + 60]) for i in range(0, 91, 10) for _ in range(3)]
    is_planted = {(i, g) for i, (_, q) in enumerate(rows) for g, own in planted.items() if q in own}
    manifest = spark.createDataFrame([(s, "A" if s < 6 else "B") for s in range(12)], "sample_id int, grp string")
    run = Pipeline(spark, reads_of(spark, rows), manifest, str(tmp_path / "work"), Params(k=15, iterations=3, size_threshold=5, min_similarity=0.8, warm_up_rounds=1))
    got = run.run()
    kept = {(x.read_no, x.grp) for x in got.collect()}
    assert kept <= is_planted and len(kept) >= 0.9 * len(is_planted)
    again = run.run("E", only=True)
    assert again.count() == len(kept)
    run.write_outputs(str(tmp_path / "out"))
    assert list((tmp_path / "out" / "reads" / "grp=A").iterdir())
    classes = {x.kmer: x.grp for x in run.per_feature().where("grp IS NOT NULL").collect()}
    assert classes and set(classes.values()) <= {"A", "B"} and min(list(classes.values()).count(g) for g in "AB") > 50


def test_streaming_counts_equal_batch(spark, tmp_path):
    reads = reads_of(spark, [(i % 2, "ACGTTGCA" * 3) for i in range(10)])
    reads.write.parquet(str(tmp_path / "in"))
    q = count_stream(read_stream(spark, str(tmp_path / "in")), 5).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(tuple(r) for r in df.select("sample_id", "kmer", "cnt").collect())
    assert rows(spark.table("streamed")) == rows(C.count_kmers(reads, 5, min_count=1))


def test_moments_of_given_groups_and_products_of_samples(spark):
    """Groups in any order of sample ids, absent samples, nearly equal large values; against numpy."""
    rng = np.random.default_rng(3)
    samples, a, b = [3, 7, 12, 20, 31], [20, 3], [31, 7, 12]
    cnt = rng.integers(0, 4, (40, 5))
    cnt[0], cnt[1] = [0, 5, 0, 0, 0], [60000, 60001, 60000, 60001, 60000]
    cnt[:, 1] = np.maximum(cnt[:, 1], 1)  # each k-mer is somewhere
    offsets = dict(zip(samples, [5.0, 5.25, 4.5, 6.0, 5.5]))
    counts = spark.createDataFrame([(s, k, int(cnt[k, j])) for k in range(40) for j, s in enumerate(samples) if cnt[k, j]], "sample_id int, kmer long, cnt long")
    v = np.log(cnt + 1) - np.array([offsets[s] for s in samples])
    moments, n1, n2 = M.group_moments(counts, offsets, a, b)
    assert (n1, n2) == (2, 3)
    at = {s: j for j, s in enumerate(samples)}
    for r in moments.collect():
        for ids, m, var in ((a, r.ma, r.va), (b, r.mb, r.vb)):
            x = v[r.kmer, [at[s] for s in ids]]
            assert abs(m - x.mean()) < 1e-12 and abs(var - x.var(ddof=1)) < 1e-12
    dense = M.dense(counts, samples)
    got = {(r.sa, r.sb): (r.cov, r.r) for r in M.correlations(M.sample_products(dense, samples)).collect()}
    cov, corr = np.cov(cnt.T), np.corrcoef(cnt.T)
    assert len(got) == 10 and all(np.isclose(c, cov[at[s], at[t]]) and np.isclose(r, corr[at[s], at[t]]) for (s, t), (c, r) in got.items())
