"""What keeps large inputs bounded: super-k-mers, large bins, equal vectors, oversized buckets, stored lookups."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmer.functions import seq, stats, vectors
from quillmer.operators import cluster as clustering
from quillmer.operators import counts as C
from quillmer.operators import extract as X
from quillmer.operators import matrix as M
from quillmer.operators import slices
from quillmer.sources import tables
from quillmer.storage import scan_bytes

SWAP = str.maketrans("ACGT", "TGCA")


def counted(reads, k, invalid="skip"):
    """Canonical k-mers of (sample, text) pairs, as text."""
    out = Counter()
    for sample, s in reads:
        s = (s or "").upper() if invalid == "skip" else "".join(c if c in "ACGT" else "A" for c in s or "")
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                out[sample, min(w, w[::-1].translate(SWAP))] += 1
    return out


def table(df, k):
    return {(r.sample_id, r.kmer): r.cnt for r in df.select("sample_id", seq.decode(F.col("kmer"), k).alias("kmer"), "cnt").collect()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    base = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 300))) for _ in range(60)]
    return [(r.randint(0, 2), s) for s in base + base[:20] + [s[::-1].translate(SWAP) for s in base[20:40]]] + [(1, "A" * 2000), (2, "ACACACAC" * 200), (0, "acgtn" * 40), (0, ""), (0, None), (1, "ACGT" * 10 + "N" + "É" + "ACGT" * 10), (2, "AC" * 5)]


def frame(spark, rows):
    return spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(rows)], "sample_id int, read_no long, seq string")


@pytest.mark.parametrize("k", [15, 23, 31])
@pytest.mark.parametrize("bin_kmers", [4_000_000, 300])
def test_counting_through_super_kmers(spark, texts, k, bin_kmers):
    got = C.count_packed(C.pack_super_kmers(frame(spark, texts), k, bins=7), k, bin_kmers=bin_kmers)
    assert table(got, k) == counted(texts, k)
    assert got.count() == got.select("sample_id", "kmer").distinct().count()


def test_both_ways_of_counting_agree(spark, texts, monkeypatch):
    reads = frame(spark, texts)
    for k in (15, 21):
        packed = table(C.count_kmers(reads, k, min_count=2, invalid="as_a"), k)
        monkeypatch.setattr(C, "PACKED_FROM", 99)
        assert packed == table(C.count_kmers(reads, k, min_count=2, invalid="as_a"), k) and packed
        monkeypatch.undo()
    assert C.count_kmers(reads.where("false"), 23).count() == 0


def test_super_kmers_cross_the_network_in_few_bytes(spark):
    r = random.Random(3)
    rows = [(0, "".join(r.choice("ACGT") for _ in range(150))) for _ in range(20_000)]
    packed = C.pack_super_kmers(frame(spark, rows).coalesce(1), 23)
    size = packed.agg(F.sum(F.length("runs") + F.length("bases") + 40)).first()[0]
    kmers = 20_000 * 128
    assert packed.agg(F.sum("n")).first()[0] == kmers and size < kmers * 20 / 3  # a k-mer, sample and count by themselves are 20 bytes


def test_rows_of_super_kmers_are_as_long_for_many_samples(spark, monkeypatch, tmp_path):
    """Bins follow a sample's share of the input; rows of a few bases cost more than their k-mers. Counting spreads many rows at once."""
    r = random.Random(5)
    rows = [(i % 20, "".join(r.choice("ACGT") for _ in range(500))) for i in range(400)]
    monkeypatch.setattr(C, "BINS", 1)
    monkeypatch.setattr(C, "BIN_BYTES", 1000)
    monkeypatch.setattr(seq, "EXPAND", 100)
    monkeypatch.setattr(C, "FLUSH", 1500)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "reads"))
    monkeypatch.setattr(C, "spread", lambda df: df.coalesce(1))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    packed, fine = C.pack_super_kmers(reads, 15), C.pack_super_kmers(reads, 15, samples=1)
    assert packed.count() * 5 < fine.count()
    assert table(C.count_packed(packed, 15), 15) == table(C.count_packed(fine, 15), 15) == counted(rows, 15)


def test_windows_of_many_reads(spark, texts):
    rows = [t for t in texts if t[1]]
    for invalid in ("as_a", "skip"):
        got = C.read_kmers(frame(spark, rows), 7, invalid)
        each = defaultdict(dict)
        for x in got.select("read_no", "pos", seq.decode(F.col("kmer"), 7).alias("w")).collect():
            each[x.read_no][x.pos] = x.w
        for i, (_, s) in enumerate(rows):
            raw = s.encode().decode("latin-1")  # positions count bytes
            raw = "".join(c if c in "ACGT" else "A" for c in raw) if invalid == "as_a" else raw.upper()
            want = {p: min(w, w[::-1].translate(SWAP)) if set(w) <= set("ACGT") else None for p in range(len(raw) - 6) for w in (raw[p : p + 7],)}
            assert each[i] == want
        sums = {(x.read_no, x.kmer): x.n for x in C.read_kmer_counts(frame(spark, rows), 7, invalid).collect()}
        again = {(x.read_no, x.kmer): x["count"] for x in got.groupBy("read_no", "kmer").count().collect()}
        assert sums == again


@pytest.mark.parametrize("k", [7, 17])
def test_blocks_ask_once_for_each_kmer(spark, texts, k, monkeypatch):
    """Counters and votes as by a join of every window, in blocks of any size; distinct k-mers of a block cross the network, not its windows."""
    reads = frame(spark, [t for t in texts if t[1]] + [(0, "ACGTTGCA" * 200), (None, "ACGTTGCA" * 9)])
    counts = C.count_kmers(reads, k, min_count=2).cache()
    met = C.read_kmers(reads, k, "skip").join(counts, ["sample_id", "kmer"], "left").collect()
    want = defaultdict(dict)
    for x in met:
        want[x.read_no][x.pos] = x.cnt or 0
    want = {i: [w[p] for p in sorted(w)] for i, w in want.items()}
    marked = counts.where("kmer % 3 = 0").select("kmer").distinct().cache()
    few = {r.kmer for r in marked.collect()}
    hits = defaultdict(int)
    for x in C.read_kmers(reads.where(F.length("seq") >= k + 10), k).collect():
        hits[x.read_no] += x.kmer in few
    for size, held in ((4 << 20, 64 << 20), (300, 64 << 20), (4 << 20, 2000)):
        monkeypatch.setattr(C, "BLOCK_BASES", size)
        monkeypatch.setattr(C, "HELD_BASES", held)
        assert {r.read_no: r.counters for r in C.counters_for_reads(reads, counts, k).collect()} == want
        assert {r.read_no: r.hits for r in X.votes(reads, marked, k).collect()} == hits
    asked = []
    one = frame(spark, [(0, "ACGTTGCA" * 200), (0, "TTGCAACG" * 200)]).coalesce(1)
    monkeypatch.undo()
    C.by_blocks(one, k, lambda a: asked.append(a) or a.withColumn("x", F.lit(1).cast("long")), lambda x, bounds: pa.array(np.diff(bounds)), "long").count()
    assert asked[0].count() <= 8  # of 3,200 windows


def test_letters_as_bases(spark):
    texts = ["Ab-z9\n", "", None, "İK ß Ω", "ZzYy" * 3]
    got = tables.text_reads(spark.createDataFrame([(i, t, "src3") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    old = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), tables.LETTERS, tables.AS_BASES)
    want = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", old).collect()
    assert sorted((r.read_no, r.seq) for r in got.collect()) == sorted(map(tuple, want))


def test_rolling_windows_by_doubling():
    r = np.random.default_rng(1)
    code = r.integers(0, 4, 200)
    for k in (1, 2, 3, 7, 16, 31):
        fwd, rc = seq._rolled(code, k)
        for i in (0, 5, 200 - k):
            w = code[i : i + k].tolist()
            assert fwd[i] == sum(x * 4 ** (k - 1 - j) for j, x in enumerate(w)) and rc[i] == sum((3 - x) * 4**j for j, x in enumerate(w))
        assert len(fwd) == 200 - k + 1
    x = r.integers(0, 99, 50)
    for w in (1, 2, 3, 8, 13, 50):
        assert seq._lowest(x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


# --- clustering -------------------------------------------------------------------------------------------------------


def profiles(n, dim=6, seed=5):
    r = np.random.default_rng(seed)
    heads = r.normal(size=(max(1, n // 8), dim))
    v = heads[r.integers(0, len(heads), n)] + 0.05 * r.normal(size=(n, dim))
    return [(i, [float(x) for x in v[i]], int(1 + i % 3)) for i in range(n)]


def one_round(rows, threshold, dim, seed):
    """Buckets by planes and the order-dependent merge, row by row."""
    bits = int(math.log2(len(rows)))
    planes = vectors.planes(bits, dim, seed)
    buckets = defaultdict(list)
    for i, v, n in sorted(rows):
        buckets[tuple(float(np.dot(v, p)) >= 0 for p in planes)].append(([i], np.array(v), n))
    out = {}
    for rows_ in buckets.values():
        i = 1
        while i < len(rows_):
            ids, v, n = rows_[i]
            for j in range(i):
                other, w, m = rows_[j]
                cos = float(v @ w) / (math.sqrt(float(v @ v)) * math.sqrt(float(w @ w))) if v.any() and w.any() else -1
                if cos >= threshold:
                    rows_[j] = (other + ids, (w * m + v * n) / (m + n), m + n)
                    last = rows_.pop()
                    if i < len(rows_):
                        rows_[i] = last
                    break
            else:
                i += 1
        for ids, v, n in rows_:
            out[min(ids)] = (sorted(ids), v, n)
    return out


def test_a_round_equals_brute_force(spark):
    rows = profiles(400) + [(1000, [0.0] * 6, 1), (1001, [0.0] * 6, 2)]
    df = spark.createDataFrame(rows, "cluster_id long, values array<double>, n long").repartition(3)
    got = clustering.merge_round(df, 0.95, n=len(rows), dim=6, seed=11, bucket_threshold=10_000).collect()
    want = one_round(rows, 0.95, 6, 11)
    members = defaultdict(list)
    for r in got:
        members[r.cluster_id].append(r.old_id)
    assert {c: sorted(m) for c, m in members.items()} == {c: m for c, (m, _, _) in want.items()} and len(want) < 350
    for r in got:
        if r["values"] is not None:
            assert np.allclose(r["values"], want[r.cluster_id][1]) and r.n == want[r.cluster_id][2]


def test_equal_vectors_are_one_row_from_the_start(spark):
    hot = [(i, [1.0, 2.0, 3.0], 1) for i in range(5, 3000)]
    rows = hot + [(1, [1.0, 2.0, 3.0], 4), (2, [0.0, 0.0, 0.0], 1), (3, [0.0, 0.0, 0.0], 1), (4, [float("nan"), 1.0, 1.0], 1), (4000, [-0.0, 5.0, 0.0], 1), (4001, [0.0, 5.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "cluster_id long, values array<double>, n long")
    classes, moved = clustering.equal_classes(df)
    assert sorted((r.cluster_id, r.n) for r in classes.collect()) == [(1, 2999), (2, 1), (3, 1), (4, 1), (4000, 2)]
    assert {tuple(r) for r in moved.collect()} == {(i, 1) for i in range(5, 3000)} | {(4001, 4000)}
    clusters, members = clustering.cluster(df, 3, iterations=2, bucket_threshold=50)
    assert sorted((r.cluster_id, r.n) for r in clusters.collect()) == [(1, 2999), (2, 1), (3, 1), (4, 1), (4000, 2)]
    assert members.count() == len(rows) and members.where("cluster_id = 1").count() == 2996


def test_buckets_stay_below_their_limit(spark):
    r = np.random.default_rng(8)
    alike = [(i, [float(x) for x in np.array([1.0, 1.0, 1.0, 1.0]) * (1 + i / 7)], 1) for i in range(900)]  # one direction: planes never part them
    near = [(1000 + i, [float(x) for x in np.array([5.0, -3.0, 1.0, 0.5]) + 0.2 * r.normal(size=4)], 1) for i in range(900)]
    df = spark.createDataFrame(alike + near, "cluster_id long, values array<double>, n long")
    keyed = clustering.with_buckets(df, 1800, 4, 3, 60)
    sizes = [x["count"] for x in keyed.groupBy("bucket").count().collect()]
    assert sum(sizes) == 1800 and max(sizes) <= 2 * 60
    clusters, members = clustering.cluster(df, 4, iterations=6, bucket_threshold=60)
    assert clusters.where("cluster_id < 1000").count() <= 2 and members.count() == 1800
    n = {x.cluster_id: x.n for x in clusters.collect()}
    assert n == {x.cluster_id: x["count"] for x in members.groupBy("cluster_id").count().collect()}
    centre = {x.cluster_id: x["values"] for x in clusters.collect()}
    by = defaultdict(list)
    where = {x.feature_id: x.cluster_id for x in members.collect()}
    for i, v, _ in alike + near:
        by[where[i]].append(v)
    assert all(np.allclose(np.mean(v, axis=0), centre[c]) for c, v in by.items())


def test_long_chains_of_moves(spark):
    moves = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(500, 40)], "old_id long, cluster_id long").repartition(3)
    assert {tuple(r) for r in clustering.resolved(moves).collect()} == {(i + 1, 0) for i in range(100)} | {(500, 0)}
    assert clustering.resolved(moves.where("false")).count() == 0


def test_tests_to_choose_from(spark):
    rows = [(i, 10, [float(x) for x in np.concatenate([m + s * np.linspace(-1, 1, 6), np.linspace(-1.1, 1, 8)])]) for i, (m, s) in enumerate([(0, 1), (5, 1), (-5, 1), (0, 9)])]
    rows += [(10, 10, [1.0] * 14), (11, 10, [2.0] * 6 + [1.0] * 8), (12, 1, [0.0] * 14)]
    clusters = spark.createDataFrame(rows, "cluster_id long, n long, values array<double>")
    got = {t: {x.cluster_id: x for x in clustering.test_clusters(clusters, 6, 8, size_threshold=5, test=t).collect()} for t in M.TESTS}
    for t in ("student", "welch", "mannwhitney"):
        assert {i: x.grp for i, x in got[t].items()} == {0: None, 1: "A", 2: "B", 3: None, 10: None, 11: "A"}, t
    assert got["ftest"][3].grp == "A" and got["ftest"][0].grp is None and got["ftest"][10].grp is None
    assert all(12 not in x for x in got.values())
    w = got["welch"][1]
    a, b = np.array(rows[1][2][:6]), np.array(rows[1][2][6:])
    assert math.isclose(w.t, (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 6 + b.var(ddof=1) / 8), rel_tol=1e-9)
    assert math.isclose(w.p_left, spark.range(1).select(stats.student_cdf_real(F.lit(w.t), F.lit(((a.var(ddof=1) / 6 + b.var(ddof=1) / 8) ** 2) / ((a.var(ddof=1) / 6) ** 2 / 5 + (b.var(ddof=1) / 8) ** 2 / 7)))).first()[0], rel_tol=1e-9)
    with pytest.raises(ValueError):
        clustering.test_clusters(clusters, 6, 8, test="other")


def test_lookups_don_t_shuffle_the_stored_side(spark, capsys):
    counts = spark.createDataFrame([(s, k, k % 5 + 1) for s in range(3) for k in range(200)], "sample_id int, kmer long, cnt long")
    store = C.sorted_store(counts, 4)
    wanted = spark.createDataFrame([(s, k) for s in range(4) for k in range(150, 250)], "sample_id int, kmer long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.lookup(wanted, store)
        found.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        got = {(r.sample_id, r.kmer): (r.cnt, r.found) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(s, k): ((k % 5 + 1, True) if s < 3 and k < 200 else (0, False)) for s in range(4) for k in range(150, 250)}


def test_slices_read_their_partitions_alone(spark, tmp_path, capsys):
    counts = spark.createDataFrame([(s, k, s + k + 1) for s in range(4) for k in range(100) if (s + k) % 3], "sample_id int, kmer long, cnt long")
    features = spark.createDataFrame([(k, k) for k in range(100)], "feature_id long, kmer long")
    path = str(tmp_path / "slices")
    slices.write_slices(counts, features, path, slice_rows=10)
    got = slices.read_slice(spark, path, 25, 30, [1, 3], slice_rows=10)
    assert sorted(map(tuple, got.collect())) == sorted((s, k, s + k + 1) for s in (1, 3) for k in range(25, 55) if (s + k) % 3)
    got.explain()
    filters = capsys.readouterr().out.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "slice" in filters[0] and "sample_id" in filters[0] and "feature_id" in filters[1]
    files = {r[0].split("/slices/")[1].rsplit("/", 1)[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert files == {f"sample_id={s}/slice={k}" for s in (1, 3) for k in range(2, 6)}
    again = counts.where("sample_id = 1 AND kmer < 20").withColumn("cnt", F.lit(9).cast("long"))
    slices.write_slices(again, features, path, slice_rows=10)
    rows = {(r.sample_id, r.feature_id): r.cnt for r in slices.read_slice(spark, path, 0, 100, slice_rows=10).collect()}
    assert rows == {(s, k): 9 if s == 1 and k < 20 else s + k + 1 for s in range(4) for k in range(100) if (s + k) % 3}


def test_sizes_are_of_what_is_scanned(spark, tmp_path):
    """A Python function between scan and counts made the estimate smaller, and so the bins too few."""
    spark.createDataFrame([(i, "some text " * 50, "src1") for i in range(200)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert scan_bytes(tables.text_reads(docs).select("sample_id", "seq")) == scan_bytes(docs) > 0
