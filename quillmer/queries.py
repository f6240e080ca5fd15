"""Registry of the engine's queries over the standard tables, each with the DuckDB SQL that gives the same rows.

Documents are read as sequences (``sources.tables.text_reads``) with k = 7, embeddings as profiles of 64 samples. Doubles
are rounded to six digits in both engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import distributions, seq, stats, vectors
from .operators import cluster as clustering
from .operators import counts as C
from .operators import extract as X
from .operators import matrix as M
from .operators import ranks as R
from .operators import slices
from .sources import binary, fastx, files, kmerdb, tables
from .storage import fresh_path

K, SIG = 7, 5
DIM, PLANES, WIDTH, OFFSET = 64, vectors.planes(8, 64), 0.7, 0.35

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- shared pieces of SQL ---------------------------------------------------------------------------------------------

_READS = f"reads AS MATERIALIZED (SELECT CAST(substr(source, 4) AS INT) AS sample_id, doc_id AS read_no, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{tables.LETTERS}', '{tables.AS_BASES}') AS seq FROM documents)"
_WINDOWS = f"windows AS (SELECT sample_id, read_no, i - 1 AS pos, substr(seq, i, {K}) AS w FROM (SELECT *, unnest(range(1, length(seq) - {K - 2})) AS i FROM reads))"
_LONG = lambda k: f"windows AS (SELECT sample_id, substr(seq, i, {k}) AS w FROM (SELECT *, unnest(range(1, length(seq) - {k - 2})) AS i FROM reads))"
_CANON = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"
_C1 = f"{_READS}, {_WINDOWS}, c1 AS MATERIALIZED (SELECT sample_id, {_CANON} AS kmer, least(count(*), 65535) AS cnt FROM windows GROUP BY ALL)"
_C2 = f"{_C1}, c2 AS MATERIALIZED (SELECT * FROM c1 WHERE cnt >= 2), samples AS (SELECT DISTINCT sample_id FROM reads), feats AS (SELECT DISTINCT kmer FROM c2)"
_STATS = f"{_C2}, st AS MATERIALIZED (SELECT sample_id, sum(ln(cnt)) AS coverage, (SELECT count(*) FROM feats) AS n_features, CAST(sum(cnt) AS BIGINT) AS total FROM c2 GROUP BY sample_id)"
_DENSE = f"{_STATS}, dense AS MATERIALIZED (SELECT kmer, sample_id, coalesce(cnt, 0) AS cnt, ln(coalesce(cnt, 0) + 1) - coalesce(coverage / n_features, 0) AS v, coalesce(cnt * 1e6 / coverage, 0) AS freq FROM feats CROSS JOIN samples LEFT JOIN c2 USING (kmer, sample_id) LEFT JOIN st USING (sample_id))"
_MOMENTS = f"{_DENSE}, mo AS (SELECT kmer, avg(v) FILTER (sample_id < 10) AS ma, avg(v) FILTER (sample_id >= 10) AS mb, var_samp(v) FILTER (sample_id < 10) AS va, var_samp(v) FILTER (sample_id >= 10) AS vb, count(*) FILTER (sample_id < 10) AS na, count(*) FILTER (sample_id >= 10) AS nb FROM dense GROUP BY kmer)"
_T18 = "(0.5 + 0.5 * sin(atan(t / sqrt(18.0))) * " + "".join(f"(1.0 + {j - 1}.0 / {j}.0 * (18.0 / (18.0 + t * t)) * " for j in range(2, 17, 2)) + "1.0" + ")" * 8 + ")"
_TTEST = f"{_MOMENTS}, tt AS (SELECT *, (ma - mb) / sqrt((9 * va + 9 * vb) / 18 * 0.2) AS t FROM mo), tp AS (SELECT *, {_T18} AS p_left FROM tt)"
_PACK = " + ".join(f"(strpos('ACGT', substr({{0}}, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))
_UNPACK = " || ".join(f"substr('ACGT', CAST(1 + (p // {4 ** (K - 1 - i)}) % 4 AS BIGINT), 1)" for i in range(K))
_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: {a}[i] * {b}[i]))"
_LIST = lambda p: "[" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in p) + "]"
_SRP = " + ".join(f"CASE WHEN {_DOT('v', _LIST(p))} >= 0 THEN {2 ** (len(PLANES) - 1 - i)} ELSE 0 END" for i, p in enumerate(PLANES))
_R = lambda x: f"round({x}, 6) + 0.0"


def query(sql: str | None = None):
    """Register the function as a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(x: Column, name: str) -> Column:
    return (F.round(x, 6) + 0.0).alias(name)


# --- shared frames ----------------------------------------------------------------------------------------------------


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return tables.text_reads(tables.read_table(spark, d, "documents"))


def _counts(spark: SparkSession, d: str, min_count: int = 2, **args) -> DataFrame:
    return C.count_kmers(_reads(spark, d), K, min_count=min_count, invalid="as_a", **args)


def _samples(spark: SparkSession, d: str) -> list[int]:
    return [r[0] for r in _reads(spark, d).select("sample_id").distinct().orderBy("sample_id").collect()]  # the manifest


def _text(df: DataFrame, *rest) -> DataFrame:
    return df.select(seq.decode(F.col("kmer"), K).alias("kmer"), *rest)


def _kept(counts: DataFrame) -> DataFrame:
    from .storage import stored

    return stored(counts, "counts")


def _offsets(counts: DataFrame) -> dict[int, float]:
    return {r["sample_id"]: r["offset"] for r in C.sample_stats(counts).collect()}  # a row per sample


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    samples, counts = _samples(spark, d), _kept(_counts(spark, d))
    return M.lognorm(M.dense(counts, samples), _offsets(counts), samples), samples


def _long(spark: SparkSession, d: str) -> DataFrame:
    dense, samples = _vectors(spark, d)
    ids = F.array(*[F.lit(s) for s in samples])
    return dense.select("kmer", F.explode(F.zip_with(ids, "values", lambda s, v: F.struct(s.alias("sample_id"), v.alias("v")))).alias("x")).select("kmer", "x.*")


def _moments(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    samples, counts = _samples(spark, d), _kept(_counts(spark, d))
    return M.group_moments(counts, _offsets(counts), *_groups(samples))


def _groups(samples: list[int]) -> tuple[list[int], list[int]]:
    return [x for x in samples if x < tables.GROUP_A], [x for x in samples if x >= tables.GROUP_A]


def _frequencies(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """(kmer, a, b, zeros, total): frequencies per million of each group's samples."""
    samples, counts = _samples(spark, d), _kept(_counts(spark, d))
    coverage = {r["sample_id"]: r["coverage"] for r in C.sample_stats(counts).collect()}  # a row per sample
    a, b = _groups(samples)
    return M.frequencies(counts, coverage, a, b), len(a), len(b)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# --- sources and sequence functions -----------------------------------------------------------------------------------


@query(f"WITH {_READS} SELECT sample_id, CASE WHEN sample_id < 10 THEN 'A' ELSE 'B' END AS grp, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY ALL")
def manifest(spark, d):
    return _reads(spark, d).groupBy("sample_id", tables.group_of().alias("grp")).agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("bases"))


@query("SELECT CAST(row_number() OVER (ORDER BY grp, n) - 1 AS INTEGER) AS sample_id, grp, '/reads/' || source || '.fq' AS path, 'db_' || source AS db FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'A' ELSE 'B' END AS grp FROM documents WHERE source IS NOT NULL)")
def manifest_files(spark, d):
    """The samples of the documents as two manifest files, read as one."""
    path = fresh_path(spark, "manifests")
    own = tables.read_table(spark, d, "documents").where("source IS NOT NULL").select("source", F.substring("source", 4, 10).cast("int").alias("sample_id")).distinct()
    for g in "AB":
        lines = own.where(tables.group_of() == g).coalesce(1).sortWithinPartitions("sample_id")  # a row per sample
        lines.select(F.concat(F.lit("  /reads/"), "source", F.lit(".fq\tdb_"), "source", F.lit("\n")).alias("value")).write.text(f"{path}/{g}")
    return files.read_manifest(spark, f"{path}/A", f"{path}/B")


@query(f"WITH {_EMB} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS feature_id, CAST(len(v) AS BIGINT) AS n, {_R('list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS total, {_R('v[3] / sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS third FROM e")
def matrix_text(spark, d):
    """Vectors written as a text matrix and read back by line, normalised."""
    path = fresh_path(spark, "matrix")
    files.write_matrix(_embeddings(spark, d).select(F.col("vec_id").alias("cluster_id"), F.col("v").alias("values"), F.lit(1).alias("n")), path)
    back = files.read_matrix(spark, path, l2=True)
    return back.select("feature_id", F.size("values").cast("long").alias("n"), r6(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), "total"), r6(F.col("values")[2], "third"))


@query(f"WITH {_READS} SELECT sample_id, read_no, CAST(length(seq) AS BIGINT) AS bases, md5(seq) AS digest FROM reads")
def reads_encode(spark, d):
    return _reads(spark, d).select("sample_id", "read_no", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"))


@query(f"WITH {_READS} SELECT read_no, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM reads")
def revcomp(spark, d):
    return _reads(spark, d).select("read_no", F.md5(seq.revcomp(F.col("seq"))).alias("digest"))


def _raw(spark, d):
    return _text(C.universe(_counts(spark, d, 1, both_strands=False)))


@query(f"WITH {_READS}, {_WINDOWS} SELECT DISTINCT w AS kmer, {_CANON} AS canonical FROM windows")
def canonical(spark, d):
    return _raw(spark, d).select("kmer", seq.canonical(F.col("kmer")).alias("canonical"))


@query(f"WITH {_READS}, {_WINDOWS} SELECT DISTINCT w AS kmer, CAST({_PACK.format('w')} AS BIGINT) AS packed FROM windows")
def kmer_pack(spark, d):
    return _raw(spark, d).select("kmer", seq.encode(F.col("kmer")).alias("packed"))


@query(f"WITH {_READS}, {_WINDOWS}, p AS (SELECT DISTINCT CAST({_PACK.format('w')} AS BIGINT) AS p FROM windows) SELECT p AS packed, {_UNPACK} AS kmer FROM p")
def kmer_unpack(spark, d):
    return C.universe(_counts(spark, d, 1, both_strands=False)).select(F.col("kmer").alias("packed"), seq.decode(F.col("kmer"), K).alias("kmer"))


def _rolled(spark, d, roll):
    kmers = C.universe(_counts(spark, d, 1)).withColumn("base", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return _text(kmers, "base", seq.decode(roll(F.col("kmer"), F.col("base"), K), K).alias("rolled"))


@query(f"WITH {_C1} SELECT DISTINCT kmer, CAST(b AS INT) AS base, substr(kmer, 2) || substr('ACGT', b + 1, 1) AS rolled FROM c1, range(4) t(b)")
def roll_forward(spark, d):
    return _rolled(spark, d, seq.roll_forward)


@query(f"WITH {_C1} SELECT DISTINCT kmer, CAST(b AS INT) AS base, substr('ACGT', b + 1, 1) || substr(kmer, 1, {K - 1}) AS rolled FROM c1, range(4) t(b)")
def roll_backward(spark, d):
    return _rolled(spark, d, seq.roll_backward)


@query(f"WITH {_C1} SELECT DISTINCT kmer, CAST(i AS INT) AS link, CASE WHEN i < 4 THEN substr(kmer, 2) || substr('ACGT', i + 1, 1) ELSE substr('ACGT', i - 3, 1) || substr(kmer, 1, {K - 1}) END AS neighbour FROM c1, range(8) t(i)")
def neighbour_links(spark, d):
    kmers = C.universe(_counts(spark, d, 1)).select("kmer", F.posexplode(seq.links(F.col("kmer"), K)).alias("link", "n"))
    return _text(kmers, "link", seq.decode(F.col("n"), K).alias("neighbour"))


_MM = " , ".join(f"(substr(kmer, {i}, {SIG}))" for i in range(1, K - SIG + 2))
_MPACK = lambda m: " + ".join(f"(strpos('ACGT', substr({m}, {i + 1}, 1)) - 1) * {4 ** (SIG - 1 - i)}" for i in range(SIG))
_MVAL = lambda m: f"CASE WHEN {m} LIKE '%TGT' OR {m} LIKE '%TT_' OR {m} LIKE 'ACA%' OR substr({m}, 2) LIKE '%AA%' THEN {4 ** SIG} ELSE {_MPACK(m)} END"
_SIGN = lambda source: f"SELECT kmer, CAST(min(least({_MVAL('m')}, {_MVAL('rm')})) AS BIGINT) AS signature FROM (SELECT kmer, m, reverse(translate(m, 'ACGT', 'TGCA')) AS rm FROM (SELECT kmer, unnest([{_MM}]) AS m FROM {source})) GROUP BY kmer"


@query(f"WITH {_C1}, u AS (SELECT DISTINCT kmer FROM c1) {_SIGN('u')}")
def signature(spark, d):
    return _text(C.universe(_counts(spark, d, 1))).select("kmer", seq.signature(SIG, F.col("kmer")).alias("signature"))


@query(f"""WITH {_READS}, {_WINDOWS}, u AS (SELECT DISTINCT w AS kmer FROM windows), s AS ({_SIGN('u')}),
  b AS (SELECT read_no, pos, signature AS bin, CASE WHEN lag(signature) OVER o = signature THEN 0 ELSE 1 END AS new FROM windows JOIN s ON w = kmer WINDOW o AS (PARTITION BY read_no ORDER BY pos)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY read_no ORDER BY pos) AS run FROM b)
  SELECT read_no, CAST(min(pos) AS INT) AS start, CAST(count(*) + {K - 1} AS BIGINT) AS len, any_value(bin) AS bin FROM r GROUP BY read_no, run""")
def super_kmers(spark, d):
    return C.super_kmers(_reads(spark, d), K, SIG)


# --- counts and database view -----------------------------------------------------------------------------------------


@query(f"WITH {_C1} SELECT sample_id, kmer, CAST(cnt AS BIGINT) AS cnt FROM c1")
def kmer_counts(spark, d):
    return _text(_counts(spark, d, 1), "sample_id", "cnt")


@query(f"WITH {_C2} SELECT sample_id, kmer, CAST(cnt AS BIGINT) AS cnt FROM c2")
def kmer_counts_min2(spark, d):
    return _text(_counts(spark, d), "sample_id", "cnt")


@query(f"WITH {_C1} SELECT sample_id, kmer, CAST(least(cnt, 15) AS BIGINT) AS cnt FROM c1")
def kmer_saturate(spark, d):
    return _text(_counts(spark, d, 1, max_count=15), "sample_id", "cnt")


@query(f"WITH {_C2} SELECT kmer FROM feats")
def kmer_universe(spark, d):
    return _text(C.universe(_counts(spark, d)))


@query(f"WITH {_C2} SELECT row_number() OVER (ORDER BY kmer) - 1 AS feature_id, kmer FROM feats")
def kmer_ids(spark, d):
    return _text(C.features(_counts(spark, d)), "feature_id")


@query(f"WITH {_STATS} SELECT sample_id, {_R('coverage')} AS coverage FROM st")
def coverage(spark, d):
    return C.sample_stats(_kept(_counts(spark, d))).select("sample_id", r6(F.col("coverage"), "coverage"))


@query(f"WITH {_STATS} SELECT sample_id, {_R('coverage / n_features')} AS off FROM st")
def offsets(spark, d):
    return C.sample_stats(_kept(_counts(spark, d))).select("sample_id", r6(F.col("offset"), "off"))


@query(f"WITH {_C2} SELECT count(*) AS n_features FROM feats")
def n_features(spark, d):
    return C.universe(_counts(spark, d)).agg(F.count("*").alias("n_features"))


@query(f"WITH {_C2} SELECT sample_id, {K} AS k, count(*) AS total_kmers, CAST(min(cnt) AS BIGINT) AS min_count, CAST(max(cnt) AS BIGINT) AS max_count, CAST(sum(cnt) AS BIGINT) AS sum_count FROM c2 GROUP BY sample_id")
def db_info(spark, d):
    return C.db_info(_counts(spark, d), K)


@query(f"WITH {_C2} SELECT sample_id, kmer, CAST(cnt AS BIGINT) AS cnt FROM c2 WHERE cnt BETWEEN 3 AND 20")
def db_range_filter(spark, d):
    return _text(C.in_range(_counts(spark, d), 3, 20), "sample_id", "cnt")


@query(f"WITH {_C2}, q AS MATERIALIZED (SELECT sample_id + 1 AS sample_id, kmer FROM c2), met AS (SELECT sample_id, kmer, max(cnt) AS cnt FROM (SELECT sample_id, kmer, NULL AS cnt FROM q UNION ALL SELECT c2.sample_id, kmer, cnt FROM c2 SEMI JOIN q USING (sample_id, kmer)) GROUP BY ALL) SELECT sample_id, kmer, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt, cnt IS NOT NULL AS found FROM met")
def db_exists(spark, d):
    """Point lookups in a stored table that is bucketed and sorted by its key: only what is looked up is shuffled."""
    counts = C.sorted_store(_counts(spark, d))
    return _text(C.lookup(counts.select((F.col("sample_id") + 1).alias("sample_id"), "kmer"), counts), "sample_id", "cnt", "found")


@query(f"WITH {_READS}, {_LONG(23)} SELECT sample_id, {_CANON} AS kmer, CAST(least(count(*), 65535) AS BIGINT) AS cnt FROM windows GROUP BY ALL HAVING count(*) >= 2")
def kmer_counts_long(spark, d):
    """k = 23, through super-k-mers."""
    return C.count_kmers(_reads(spark, d), 23, min_count=2).select(seq.decode(F.col("kmer"), 23).alias("kmer"), "sample_id", "cnt")


_DB = f"{_READS}, {_LONG(15)}, db AS (SELECT {_CANON} AS kmer, CAST(least(count(*), 65535) AS BIGINT) AS cnt FROM windows GROUP BY ALL)"


def _database(spark, d) -> str:
    """A k-mer database (k = 15) of all documents in the shared folder."""
    path = fresh_path(spark, "kmerdb")
    kmerdb.write_kmerdb(C.count_kmers(_reads(spark, d).withColumn("sample_id", F.lit(0)), 15, min_count=1), path, 15, counter_size=2)  # counts stop at 65,535
    return path


@query(f"WITH {_DB} SELECT kmer, cnt FROM db WHERE cnt BETWEEN 3 AND 200")
def db_scan(spark, d):
    """Written as a database and scanned in ranges of its records; the bounds are pushed into the scan."""
    scan = kmerdb.read_kmerdb(spark, _database(spark, d), records=500_000).where(F.col("cnt").between(3, 200))
    return scan.select(seq.decode(F.col("kmer"), 15).alias("kmer"), "cnt")


@query(f"WITH {_DB} SELECT kmer, cnt FROM db WHERE kmer >= 'CAAAAAAAAAAAAAA' AND kmer < 'CCAAAAAAAAAAAAA'")
def db_range_scan(spark, d):
    """The k-mers of a range: only the prefixes in it are read."""
    low, high = 4**14, 4**14 + 4**13
    scan = kmerdb.read_kmerdb(spark, _database(spark, d), records=500_000).where((F.col("kmer") >= low) & (F.col("kmer") < high))
    return scan.select(seq.decode(F.col("kmer"), 15).alias("kmer"), "cnt")


@query(f"WITH {_READS} SELECT 'doc' || CAST(read_no AS VARCHAR) AS name, CAST(length(seq) AS BIGINT) AS bases, md5(seq) AS digest, CAST(length(seq) AS BIGINT) AS n_qual FROM reads")
def fastq_ranges(spark, d):
    """The documents as FASTQ files, a folder for each sample, read back in byte ranges."""
    path = fresh_path(spark, "fastq")
    reads = _reads(spark, d).select(tables.group_of().alias("grp"), F.coalesce(F.col("sample_id").cast("string"), F.lit("none")).alias("sample"), "name", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    files.write_fastq(reads, path)
    back = fastx.read_fastx(spark, [path], split_bytes=1 << 20)
    return back.select("name", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("digest"), F.length("qual").cast("long").alias("n_qual"))


@query(f"WITH {_C2}, w AS (SELECT sample_id, read_no, pos, {_CANON} AS kmer FROM windows) SELECT w.sample_id, read_no, count(*) AS n, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS total, CAST(sum(coalesce(cnt, 0) * (pos % 97)) AS BIGINT) AS weighted FROM w LEFT JOIN c2 USING (sample_id, kmer) GROUP BY ALL")
def counters_for_read(spark, d):
    c = C.counters_for_reads(_reads(spark, d), _kept(_counts(spark, d)), K)
    total = F.aggregate("counters", F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("counters", lambda x, i: x * (i % 97)), F.lit(0).cast("long"), lambda a, x: a + x)
    each = c.select("sample_id", "read_no", F.size("counters").cast("long").alias("n"), total.alias("total"), weighted.alias("weighted"))
    return each.groupBy("sample_id", "read_no").agg(*[F.sum(x).alias(x) for x in ("n", "total", "weighted")])  # repeated reads together


# --- matrix -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_DENSE} SELECT kmer, sample_id, CAST(cnt AS BIGINT) AS cnt FROM dense")
def count_matrix(spark, d):
    samples = _samples(spark, d)
    ids = F.array(*[F.lit(s) for s in samples])
    rows = M.dense(_counts(spark, d), samples).select("kmer", F.explode(F.zip_with(ids, "values", lambda s, v: F.struct(s.alias("sample_id"), v.cast("long").alias("cnt")))).alias("x"))
    return _text(rows, "x.sample_id", "x.cnt")


_NUMBERED = f"{_C2}, f AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS feature_id FROM feats)"


@query(f"WITH {_NUMBERED} SELECT sample_id, feature_id, CAST(cnt AS BIGINT) AS cnt FROM c2 JOIN f USING (kmer) WHERE feature_id BETWEEN 1000 AND 3499 AND sample_id < 10")
def matrix_slice(spark, d):
    """2,500 features of the first group's samples, from the table by sample and range."""
    counts, path = _kept(_counts(spark, d)), fresh_path(spark, "slices")
    slices.write_slices(counts, C.features(counts), path, slice_rows=500)
    return slices.read_slice(spark, path, 1000, 2500, list(range(tables.GROUP_A)), slice_rows=500)


#: clusters by the remainder of the feature's id, with the mean counts of their members
_GROUPED = f"""{_NUMBERED}, g AS (SELECT feature_id % 700 AS cluster_id, feature_id, kmer FROM f), n AS (SELECT cluster_id, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 5),
  w AS (SELECT cluster_id, n, row_number() OVER (ORDER BY cluster_id) - 1 AS row_id FROM n)"""


def _pairs(spark, d) -> tuple[str, int]:
    """The clusters as pairs of a binary and a text file; the number of samples."""
    samples, counts, path = _samples(spark, d), _kept(_counts(spark, d)), fresh_path(spark, "pairs")
    rows = _kept(M.dense(counts, samples).join(C.features(counts), "kmer").select((F.col("feature_id") % 700).alias("cluster_id"), "feature_id", "values"))
    means = rows.select("cluster_id", F.posexplode("values").alias("pos", "x")).groupBy("cluster_id", "pos").agg((F.sum("x") / F.count("*")).alias("x"), F.count("*").alias("n"))
    clusters = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("values"), F.max("n").alias("n"))
    binary.write_clusters(clusters, rows.select("cluster_id", "feature_id"), path)
    return path, len(samples)


@query(f"WITH {_GROUPED}, v AS (SELECT cluster_id, sample_id, CAST(sum(coalesce(cnt, 0)) AS DOUBLE) AS total FROM g CROSS JOIN samples LEFT JOIN c2 USING (kmer, sample_id) GROUP BY ALL) SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY sample_id) - 1 AS pos, CAST(CAST(total / n AS FLOAT) AS DOUBLE) AS value FROM w JOIN v USING (cluster_id) WHERE row_id BETWEEN 10 AND 209")
def cluster_window_centroids(spark, d):
    """A window of centroids from the binary file."""
    path, width = _pairs(spark, d)
    return binary.read_clusters(spark, path, "centroids", width, start=10, num=200).select("row_id", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_GROUPED} SELECT row_id, feature_id FROM w JOIN g USING (cluster_id) WHERE row_id BETWEEN 10 AND 209")
def cluster_window_members(spark, d):
    """A window of members from the text file, through its index of lines."""
    path, width = _pairs(spark, d)
    return binary.read_clusters(spark, path, "members", width, start=10, num=200)


@query(f"WITH {_DENSE} SELECT kmer, sample_id, {_R('v')} AS v FROM dense")
def lognorm_matrix(spark, d):
    return _text(_long(spark, d), "sample_id", r6(F.col("v"), "v"))


@query(f"WITH {_C2} SELECT kmer, CAST(sum(cnt) AS BIGINT) AS total FROM c2 GROUP BY kmer HAVING sum(cnt) > 0.1 * (SELECT count(*) FROM samples)")
def rarity_filter(spark, d):
    return _text(M.rarity_filter(_counts(spark, d), len(_samples(spark, d))), "total")


@query(f"WITH {_C2} SELECT kmer, CAST((SELECT count(*) FROM samples) - count(*) AS BIGINT) AS zeros FROM c2 GROUP BY kmer HAVING (SELECT count(*) FROM samples) - count(*) < 0.7 * (SELECT count(*) FROM samples)")
def zero_gate(spark, d):
    return _text(M.zero_gate(_counts(spark, d), len(_samples(spark, d))), "zeros")


@query(f"WITH {_C2} SELECT kmer, CAST(sum(cnt) AS BIGINT) AS total FROM c2 GROUP BY kmer HAVING sum(cnt) > 2 * (SELECT count(*) FROM samples)")
def large_count(spark, d):
    return _text(M.large_count(_counts(spark, d), len(_samples(spark, d))), "total")


@query(f"WITH {_STATS} SELECT sample_id, kmer, {_R('cnt * 1e6 / coverage')} AS freq FROM c2 JOIN st USING (sample_id)")
def freq_per_million(spark, d):
    counts = _kept(_counts(spark, d))
    return _text(M.per_million(counts, C.sample_stats(counts)), "sample_id", r6(F.col("freq"), "freq"))


@query(f"WITH {_DENSE} SELECT kmer, count(*) AS n, {_R('sum(v)')} AS total, {_R('min(v)')} AS low, {_R('max(v)')} AS high FROM dense GROUP BY kmer")
def feature_vectors(spark, d):
    dense, _ = _vectors(spark, d)
    return _text(dense, F.size("values").cast("long").alias("n"), r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), "total"), r6(F.array_min("values"), "low"), r6(F.array_max("values"), "high"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query(f"WITH {_TTEST} SELECT kmer, {_R('t')} AS t, {_R('p_left')} AS p_left, {_R('1 - p_left')} AS p_right, {_R('2 * least(p_left, 1 - p_left)')} AS p_both FROM tp")
def ttest(spark, d):
    return _text(M.ttest(*_moments(spark, d)), *[r6(F.col(c), c) for c in ("t", "p_left", "p_right", "p_both")])


@query(f"WITH {_TTEST} SELECT kmer, {_R('t')} AS t, CASE WHEN p_left <= 0.01 THEN 'B' ELSE 'A' END AS grp FROM tp WHERE p_left <= 0.01 OR 1 - p_left <= 0.01")
def ttest_classes(spark, d):
    return _text(M.ttest(*_moments(spark, d)).where("grp IS NOT NULL"), r6(F.col("t"), "t"), "grp")


@query(f"WITH {_MOMENTS} SELECT kmer, {_R('va / vb')} AS f FROM mo")
def ftest_stat(spark, d):
    m, _, _ = _moments(spark, d)
    return _text(m, r6(F.col("va") / F.col("vb"), "f"))


@query(f"WITH {_MOMENTS} SELECT kmer, {_R('(ma - mb) / sqrt(va / na + vb / nb)')} AS t, {_R('power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))')} AS df FROM mo")
def welch_stat(spark, d):
    m, n1, n2 = _moments(spark, d)
    t, df = stats.welch(n1, F.col("ma"), F.col("va"), n2, F.col("mb"), F.col("vb"))
    return _text(m, r6(t, "t"), r6(df, "df"))


def _simpson(f: Callable[[str], str], high: str, steps: int = 1600) -> str:
    """SQL of the integral of ``f`` from 0 to ``high``."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * ({f(f'(i * ({high}) / {steps}.0)')}))) * ({high}) / {3 * steps}.0)"


def _beta_sql(a: str, b: str, x: str, steps: int = 1600) -> str:
    """SQL of the regularised incomplete beta function as an integral over an angle."""
    f = lambda y: f"power(sin({y}), 2 * ({a}) - 1) * power(cos({y}), 2 * ({b}) - 1)"
    return f"({_simpson(f, f'asin(sqrt({x}))', steps)} / {_simpson(f, 'pi() / 2', steps)})"


_T_BOTH = lambda t, df, steps=1600: _beta_sql(f"({df}) / 2.0", "0.5", f"({df}) / (({df}) + ({t}) * ({t}))", steps)
_NORMAL = lambda z: f"(0.5 + sign({z}) * {_simpson(lambda y: f'exp(-{y} * {y} / 2)', f'abs({z})')} / sqrt(2 * pi()))"


@query(f"WITH {_MOMENTS}, f AS (SELECT kmer, va / vb AS f, (na - 1) * va / ((na - 1) * va + (nb - 1) * vb) AS x, (na - 1) / 2.0 AS a, (nb - 1) / 2.0 AS b FROM mo WHERE va > 1e-12 AND vb > 1e-12), c AS (SELECT kmer, f, {_beta_sql('a', 'b', 'x')} AS c FROM f) SELECT kmer, {_R('f')} AS f, {_R('2 * least(c, 1 - c)')} AS p_both FROM c")
def ftest_p(spark, d):
    m, n1, n2 = _moments(spark, d)
    f = m.where("va > 0 AND vb > 0").select("kmer", (F.col("va") / F.col("vb")).alias("f"))
    return _text(f, r6(F.col("f"), "f"), r6(stats.two_sided(stats.f_cdf(F.col("f"), F.lit(n1 - 1.0), F.lit(n2 - 1.0))), "p_both"))


@query(f"WITH {_MOMENTS}, w AS (SELECT kmer, (ma - mb) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df FROM mo WHERE va + vb > 1e-11) SELECT kmer, {_R('t')} AS t, {_R(_T_BOTH('t', 'df'))} AS p_both FROM w")
def welch_p(spark, d):
    m, n1, n2 = _moments(spark, d)
    t, df = stats.welch(n1, F.col("ma"), F.col("va"), n2, F.col("mb"), F.col("vb"))
    w = m.where("va + vb > 1e-11").select("kmer", t.alias("t"), df.alias("df"))
    return _text(w, r6(F.col("t"), "t"), r6(stats.two_sided(stats.student_cdf_real(F.col("t"), F.col("df"))), "p_both"))


_UTEST = f"""{_DENSE}, u AS (SELECT a.kmer, sum(CASE WHEN a.freq > b.freq THEN 1.0 WHEN a.freq = b.freq THEN 0.5 ELSE 0.0 END) AS u, count(DISTINCT a.sample_id) AS n1, count(DISTINCT b.sample_id) AS n2
  FROM dense a JOIN dense b ON a.kmer = b.kmer AND a.sample_id < 10 AND b.sample_id >= 10 GROUP BY a.kmer),
  ties AS (SELECT kmer, sum(c * c * c - c) AS ties FROM (SELECT kmer, freq, CAST(count(*) AS DOUBLE) AS c FROM dense GROUP BY ALL) GROUP BY kmer),
  uz AS (SELECT kmer, u, u - n1 * n2 / 2.0 AS shift, sqrt(greatest(0.0, n1 * n2 / 12.0 * ((n1 + n2 + 1.0) - ties / ((n1 + n2) * (n1 + n2 - 1.0))))) AS sigma FROM u JOIN ties USING (kmer)),
  z AS (SELECT kmer, u, CASE WHEN sigma > 0 THEN (shift - 0.5 * sign(shift)) / sigma ELSE 0.0 END AS z FROM uz)"""


@query(f"WITH {_UTEST} SELECT kmer, CAST(u AS DOUBLE) AS u, {_R('z')} AS z FROM z")
def mannwhitney_u(spark, d):
    return _text(R.mann_whitney(*_frequencies(spark, d)), "u", r6(F.col("z"), "z"))


@query(f"WITH {_UTEST}, p AS (SELECT kmer, {_NORMAL('z')} AS c FROM z) SELECT kmer, {_R('least(0.25, greatest(0.0001, c))')} AS p_left, {_R('least(0.25, greatest(0.0001, 1 - c))')} AS p_right FROM p")
def mannwhitney_p(spark, d):
    return _text(R.mann_whitney(*_frequencies(spark, d)), r6(F.col("p_left"), "p_left"), r6(F.col("p_right"), "p_right"))


@query(f"""WITH {_UTEST}, g AS (SELECT kmer, count(*) FILTER (cnt = 0) AS zeros, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS total FROM dense GROUP BY kmer)
  SELECT kmer, CASE WHEN z <= -2.3263478740408408 THEN 'B' WHEN z >= 2.3263478740408408 THEN 'A' END AS grp, total > 2 * n AS large FROM z JOIN g USING (kmer) WHERE zeros < 0.7 * n""")
def per_feature_variant(spark, d):
    """Rank test of each k-mer's frequencies, for k-mers absent from few samples; and the k-mers of large counts."""
    f, n1, n2 = _frequencies(spark, d)
    tested = R.mann_whitney(f, n1, n2).where(F.col("zeros") < 0.7 * (n1 + n2))
    return _text(tested, M.classify(F.col("p_left"), F.col("p_right"), 0.01).alias("grp"), (F.col("total") > 2 * (n1 + n2)).alias("large"))


@query(f"WITH {_DENSE}, o AS (SELECT kmer, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM dense GROUP BY kmer) SELECT kmer, {_R('(m + 0.5) / (s / sqrt(n))')} AS t FROM o WHERE s > 1e-9")
def one_sample_t(spark, d):
    o = _long(spark, d).groupBy("kmer").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("n")).where("s > 1e-9")
    return _text(o, r6((F.col("m") + 0.5) / (F.col("s") / F.sqrt("n")), "t"))


@query(f"WITH {_DENSE}, o AS (SELECT kmer, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM dense GROUP BY kmer), t AS (SELECT kmer, n, (m + 0.5) / (s / sqrt(n)) AS t FROM o WHERE s > 1e-9) SELECT kmer, {_R(_T_BOTH('t', '(n - 1)'))} AS p_both FROM t")
def one_sample_t_p(spark, d):
    o = _long(spark, d).groupBy("kmer").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("n")).where("s > 1e-9")
    t = o.select("kmer", ((F.col("m") + 0.5) / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1.0).alias("df"))
    return _text(t, r6(stats.two_sided(stats.student_cdf_real(F.col("t"), F.col("df"))), "p_both"))


def _integers(spark, d):
    return M.dense(_counts(spark, d), _samples(spark, d))


@query(f"""WITH {_DENSE}, x AS (SELECT kmer, CAST(cnt AS DOUBLE) - 4 AS x FROM dense WHERE cnt <> 4), k AS (SELECT kmer, x, rank() OVER o + (count(*) OVER (PARTITION BY kmer, abs(x)) - 1) / 2.0 AS r FROM x WINDOW o AS (PARTITION BY kmer ORDER BY abs(x)))
  SELECT kmer, CAST(coalesce(w, 0) AS DOUBLE) AS w FROM feats LEFT JOIN (SELECT kmer, sum(r) FILTER (x > 0) AS w FROM k GROUP BY kmer) USING (kmer)""")
def signed_rank(spark, d):
    return _text(_integers(spark, d), R.signed_rank(F.col("values"), 4.0).alias("w"))


@query(f"WITH {_DENSE} SELECT kmer, count(*) FILTER (cnt > 4) AS above, count(*) FILTER (cnt <> 4) AS n FROM dense GROUP BY kmer")
def sign_test(spark, d):
    above, n = R.sign_count(F.col("values"), 4.0)
    return _text(_integers(spark, d), above.alias("above"), n.alias("n"))


@query(f"""WITH {_DENSE}, x AS (SELECT kmer, CAST(cnt AS DOUBLE) - 4 AS x FROM dense WHERE cnt <> 4), k AS (SELECT kmer, x, CAST(count(*) OVER (PARTITION BY kmer, abs(x)) AS DOUBLE) AS c, rank() OVER o + (count(*) OVER (PARTITION BY kmer, abs(x)) - 1) / 2.0 AS r FROM x WINDOW o AS (PARTITION BY kmer ORDER BY abs(x))),
  s AS (SELECT kmer, CAST(count(*) AS DOUBLE) AS m, coalesce(sum(r) FILTER (x > 0), 0) AS w, sum(c * c - 1) AS ties FROM k GROUP BY kmer),
  z AS (SELECT kmer, greatest(0.0, abs(w - m * (m + 1) / 4) - 0.5) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM s)
  SELECT kmer, {_R(f"coalesce(least(1.0, 2 * (1 - {_NORMAL('z')})), 1.0)")} AS p_both FROM feats LEFT JOIN z USING (kmer)""")
def signed_rank_p(spark, d):
    z = _kept(_integers(spark, d).select("kmer", R.signed_rank_z(F.col("values"), 4.0).alias("z")))  # a Python function over an aggregate isn't extracted
    return _text(z, r6(R.signed_rank_p(F.col("z")), "p_both"))


_TAIL = lambda k: f"coalesce(list_sum(list_transform(range(0, {k} + 1), lambda i: CAST(factorial(CAST(n AS INT)) AS DOUBLE) / factorial(CAST(i AS INT)) / factorial(CAST(n - i AS INT)))), 0) / power(2.0, n)"


@query(f"WITH {_DENSE}, s AS (SELECT kmer, count(*) FILTER (cnt > 4) AS k, count(*) FILTER (cnt <> 4) AS n FROM dense GROUP BY kmer) SELECT kmer, {_R(f'least(1.0, 2 * least({_TAIL("k")}, 1 - {_TAIL("(k - 1)")}))')} AS p_both FROM s")
def sign_test_p(spark, d):
    return _text(_integers(spark, d), r6(R.sign_p(*R.sign_count(F.col("values"), 4.0)), "p_both"))


_POP = f"{_DENSE}, mu AS (SELECT sample_id, avg(v) AS m FROM dense GROUP BY sample_id), cm AS (SELECT sample_id, count(*) AS n, any_value(m) AS m, avg(power(v - m, 2)) AS m2, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4, avg(abs(v - m)) AS adev FROM dense JOIN mu USING (sample_id) GROUP BY sample_id)"


def _sample_moments(spark, d):
    long = _long(spark, d)
    means = long.groupBy("sample_id").agg(F.avg("v").alias("m"))
    met = long.join(F.broadcast(means), "sample_id")  # a row per sample
    return met.groupBy("sample_id").agg(F.count("*").alias("n"), F.first("m").alias("mean"), F.var_samp("v").alias("variance"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), F.avg(F.abs(F.col("v") - F.col("m"))).alias("adev"))


@query(f"WITH {_POP} SELECT sample_id, n, {_R('m')} AS mean, {_R('m2 * n / (n - 1)')} AS variance, {_R('m3 / power(m2, 1.5)')} AS skew, {_R('m4 / (m2 * m2) - 3')} AS kurt, {_R('adev')} AS adev FROM cm")
def moments(spark, d):
    return _sample_moments(spark, d).select("sample_id", "n", *[r6(F.col(c), c) for c in ("mean", "variance", "skew", "kurt", "adev")])


@query(f"WITH {_POP} SELECT sample_id, {_R('n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)')} AS jb FROM cm")
def jarque_bera(spark, d):
    return _sample_moments(spark, d).select("sample_id", r6(R.jarque_bera(F.col("n"), F.col("skew"), F.col("kurt")), "jb"))


@query(f"WITH {_POP} SELECT sample_id, {_R('exp(-(n / 12.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)))')} AS p FROM cm")
def jarque_bera_p(spark, d):
    jb = _sample_moments(spark, d).select("sample_id", R.jarque_bera(F.col("n"), F.col("skew"), F.col("kurt")).alias("jb"))
    return jb.select("sample_id", r6(R.jarque_bera_p(F.col("jb")), "p"))


#: upper tail of chi-square with 19 degrees of freedom at x: e^-y / gamma(9.5) times the integral of (y + s)^8.5 e^-s, y = x / 2
_CHI19 = f"(-x / 2) / ln(10) + log10(list_sum(list_transform(range(0, 6001), lambda i: (CASE WHEN i = 0 OR i = 6000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(x / 2 + i * 0.01, 8.5) * exp(-i * 0.01))) * 0.01 / 3 / {math.gamma(9.5)!r})"


@query(f"WITH {_EMB}, s AS (SELECT vec_id, 384 * list_sum(list_transform(range(1, 20), lambda i: v[i] * v[i])) AS x FROM e) SELECT vec_id, round({_CHI19}, 5) + 0.0 AS log_p FROM s")
def chi2_tail(spark, d):
    """Scaled sums of 19 squares as chi-square: logarithms of upper tails, most below 1e-10."""
    x = F.aggregate(F.slice("v", 1, 19), F.lit(0.0), lambda s, y: s + y * y) * 384
    p = _embeddings(spark, d).select("vec_id", distributions.sf("chi2", x, F.lit(19.0)).alias("p"))
    return p.select("vec_id", (F.round(F.log10("p"), 5) + 0.0).alias("log_p"))


@query(f"WITH {_EMB}, s AS (SELECT vec_id, power(greatest(abs(v[1]), 1e-3), 6) AS p, 3.0 + vec_id % 40 AS d FROM e) SELECT vec_id, {_R('log10((1 - 2 * p) / sqrt(2 * p * (1 - p)))')} AS t, {_R('-2 * ln(p)')} AS chi2, {_R('log10(d / 2 * (power(p, -2 / d) - 1))')} AS f FROM s")
def critical_values(spark, d):
    """Critical values at probabilities down to 1e-18: Student and chi-square with two degrees of freedom, F with two and more."""
    p = F.pow(F.greatest(F.abs(F.col("v")[0]), F.lit(1e-3)), 6)
    s = _embeddings(spark, d).select("vec_id", p.alias("p"), (F.lit(3.0) + F.col("vec_id") % 40).alias("d"))
    two = F.lit(2.0)
    t, chi2, f = (distributions.critical(n, F.col("p"), two, *more, upper=True) for n, more in (("student", ()), ("chi2", ()), ("f", (F.col("d"),))))
    return s.select("vec_id", r6(F.log10(t), "t"), r6(chi2, "chi2"), r6(F.log10(f), "f"))


@query(f"WITH {_DENSE} SELECT sample_id, {_R('quantile_cont(v, 0.5)')} AS median, {_R('quantile_cont(v, 0.1)')} AS p10, {_R('quantile_cont(v, 0.9)')} AS p90 FROM dense GROUP BY sample_id")
def percentiles(spark, d):
    p = lambda q, n: r6(F.expr(f"percentile(v, {q})"), n)
    return _long(spark, d).groupBy("sample_id").agg(p(0.5, "median"), p(0.1, "p10"), p(0.9, "p90"))


def _sample_pairs(spark, d, value="v"):
    """Covariance and correlation of every two samples."""
    if value == "v":
        return M.correlations(M.sample_products(*_vectors(spark, d)))
    samples, long = _samples(spark, d), _long(spark, d)
    # mean ranks over the distinct values of a sample: counts saturate, so these are at most 65 536
    each = long.groupBy("sample_id", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("sample_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = each.select("sample_id", "v", (F.sum("c").over(w) - (F.col("c") - 1) / 2.0).alias("rank"))
    return M.correlations(M.sample_products(M.dense(long.join(ranks, ["sample_id", "v"]), samples, "rank"), samples))


_PAIR = "FROM {0} a JOIN {0} b ON a.kmer = b.kmer AND a.sample_id < b.sample_id GROUP BY a.sample_id, b.sample_id"


@query(f"WITH {_DENSE} SELECT a.sample_id AS sa, b.sample_id AS sb, {_R('corr(a.v, b.v)')} AS r {_PAIR.format('dense')}")
def corr_pearson(spark, d):
    return _sample_pairs(spark, d).select("sa", "sb", r6(F.col("r"), "r"))


@query(f"WITH {_DENSE}, r AS (SELECT a.sample_id AS sa, b.sample_id AS sb, corr(a.v, b.v) AS r, count(*) AS n {_PAIR.format('dense')}) SELECT sa, sb, round(r * sqrt((n - 2) / (1 - r * r)), 4) + 0.0 AS t FROM r")
def corr_significance(spark, d):
    return _sample_pairs(spark, d).select("sa", "sb", (F.round(stats.corr_t(F.col("r"), F.col("n")), 4) + 0.0).alias("t"))


@query(f"WITH {_DENSE}, r AS (SELECT a.sample_id AS sa, b.sample_id AS sb, corr(a.v, b.v) AS r, count(*) AS n {_PAIR.format('dense')}), t AS (SELECT sa, sb, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r) SELECT sa, sb, {_R(_T_BOTH('t', '(n - 2)', 20000))} AS p_both FROM t")
def corr_p(spark, d):
    t = _sample_pairs(spark, d).select("sa", "sb", stats.corr_t(F.col("r"), F.col("n")).alias("t"), (F.col("n") - 2.0).alias("df"))
    return t.select("sa", "sb", r6(stats.two_sided(stats.student_cdf_real(F.col("t"), F.col("df"))), "p_both"))


@query(f"WITH {_DENSE} SELECT a.sample_id AS sa, b.sample_id AS sb, {_R('covar_samp(a.v, b.v)')} AS c {_PAIR.format('dense')}")
def cov(spark, d):
    return _sample_pairs(spark, d).select("sa", "sb", r6(F.col("cov"), "c"))


@query(f"WITH {_DENSE} SELECT a.sample_id AS sa, b.sample_id AS sb, {_R('covar_samp(a.v, b.v)')} AS c, {_R('corr(a.v, b.v)')} AS r {_PAIR.format('dense').replace('a.sample_id < b.sample_id', 'a.sample_id < 10 AND b.sample_id >= 10')}")
def cross_cov(spark, d):
    """Covariance and correlation between the samples of the two groups."""
    across = _sample_pairs(spark, d).where((F.col("sa") < tables.GROUP_A) & (F.col("sb") >= tables.GROUP_A))
    return across.select("sa", "sb", r6(F.col("cov"), "c"), r6(F.col("r"), "r"))


@query(f"WITH {_DENSE}, rk AS MATERIALIZED (SELECT kmer, sample_id, rank() OVER (PARTITION BY sample_id ORDER BY cnt) + (count(*) OVER (PARTITION BY sample_id, cnt) - 1) / 2.0 AS v FROM dense) SELECT a.sample_id AS sa, b.sample_id AS sb, {_R('corr(a.v, b.v)')} AS r {_PAIR.format('rk')}")
def corr_spearman(spark, d):
    return _sample_pairs(spark, d, "rank").select("sa", "sb", r6(F.col("r"), "r"))


# --- vectors, keys, pairs ---------------------------------------------------------------------------------------------


@query(f"WITH {_EMB}, n AS (SELECT vec_id, v, sqrt({_DOT('v', 'v')}) AS s FROM e) SELECT vec_id, CAST(i - 1 AS INT) AS pos, {_R('v[i] / s')} AS x FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM n)")
def l2_normalise(spark, d):
    return _embeddings(spark, d).select("vec_id", F.posexplode(vectors.l2_normalise(F.col("v"))).alias("pos", "y")).select("vec_id", "pos", r6(F.col("y"), "x"))


@query(f"WITH {_EMB} SELECT vec_id, CAST({_SRP} AS BIGINT) AS bucket FROM e")
def srp_key(spark, d):
    return _embeddings(spark, d).select("vec_id", vectors.srp_key(F.col("v"), PLANES).alias("bucket"))


@query(f"WITH {_EMB} SELECT CAST({_SRP} AS BIGINT) AS bucket, count(*) AS size FROM e GROUP BY ALL")
def srp_bucket_sizes(spark, d):
    return srp_key(spark, d).groupBy("bucket").agg(F.count("*").alias("size"))


_PST = " || ".join(f"CAST(CAST(trunc(({_DOT('v', _LIST(p))} + {OFFSET}) / {WIDTH}) AS INT) AS VARCHAR)" for p in PLANES[:4])


@query(f"WITH {_EMB} SELECT vec_id, {_PST} AS bucket FROM e")
def pstable_key(spark, d):
    return _embeddings(spark, d).select("vec_id", vectors.pstable_key(F.col("v"), PLANES[:4], OFFSET, WIDTH).alias("bucket"))


def _centres(spark, d):
    e = _embeddings(spark, d).withColumn("n", (F.col("vec_id") % 3 + 1)).withColumnRenamed("v", "values")
    return clustering.consensus(e, "label")


_CENTRE = f"{_EMB}, x AS (SELECT label, vec_id % 3 + 1 AS n, unnest(range(1, {DIM + 1})) AS i, v FROM e), ce AS (SELECT label, i, sum(v[i] * n) / sum(n) AS value, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY label, i)"


@query(f"WITH {_CENTRE} SELECT label, CAST(i - 1 AS INT) AS pos, {_R('value')} AS value, n FROM ce")
def consensus_by_group(spark, d):
    return _centres(spark, d).select("label", "pos", r6(F.col("value"), "value"), "n")


def _to_centre(spark, d, f, name):
    c = _centres(spark, d).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("c"))
    return _embeddings(spark, d).join(c, "label").select("vec_id", "label", r6(f(F.col("v"), F.col("c")), name))


_CLIST = f"{_CENTRE}, cl AS (SELECT label, list(value ORDER BY i) AS c FROM ce GROUP BY label)"


@query(f"WITH {_CLIST} SELECT vec_id, label, {_R('1 - ' + _DOT('v', 'c') + ' / (sqrt(' + _DOT('v', 'v') + ') * sqrt(' + _DOT('c', 'c') + '))')} AS distance FROM e JOIN cl USING (label)")
def cosine_pairs(spark, d):
    return _to_centre(spark, d, vectors.cosine_distance, "distance")


@query(f"WITH {_CLIST} SELECT vec_id, label, {_R(f'sqrt(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))))')} AS distance FROM e JOIN cl USING (label)")
def euclid_pairs(spark, d):
    return _to_centre(spark, d, vectors.euclidean, "distance")


MORE_PLANES = vectors.planes(24, DIM, 2)
_KEY24 = " + ".join(f"CASE WHEN {_DOT('v', _LIST(p))} >= 0 THEN {2 ** (23 - i)} ELSE 0 END" for i, p in enumerate(MORE_PLANES))


@query(f"WITH {_EMB}, o AS (SELECT min(vec_id) AS vec_id, v FROM e GROUP BY v), k AS (SELECT vec_id, v, CAST({_KEY24} AS BIGINT) >> (24 - least(24, CAST(floor(log2((SELECT count(*) FROM o))) AS INT))) AS bucket, sqrt({_DOT('v', 'v')}) AS s FROM o), p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.bucket, {_DOT('a.v', 'b.v')} / (a.s * b.s) AS similarity FROM k a JOIN k b ON a.bucket = b.bucket AND a.vec_id < b.vec_id) SELECT id_a, id_b, bucket, {_R('similarity')} AS similarity FROM p WHERE similarity >= 0.3")
def similar_pairs_in_bucket(spark, d):
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("v").alias("values"))
    return clustering.similar_pairs(e, MORE_PLANES, 0.3).withColumn("similarity", F.round("similarity", 6) + 0.0)


@query("SELECT count(*) AS n, count(DISTINCT CAST(embedding AS VARCHAR)) AS n_different FROM embeddings")
def vector_equal(spark, d):
    """Vectors that are equal element by element, counted as one."""
    e = tables.read_table(spark, d, "embeddings")
    one = e.groupBy("embedding").agg(F.count("*").alias("c"))
    return one.agg(F.sum("c").alias("n"), F.count("*").alias("n_different"))


# --- clustering (iterative: no SQL) -----------------------------------------------------------------------------------


def _clustered(spark, d):
    samples, counts = _samples(spark, d), _kept(_counts(spark, d))
    dense = M.lognorm(M.dense(counts, samples), _offsets(counts), samples)
    frequent = dense.join(M.rarity_filter(counts, len(samples)).select("kmer"), "kmer", "left_semi")
    return *clustering.cluster(frequent.select(F.col("kmer").alias("cluster_id"), "values", F.lit(1).cast("long").alias("n")), len(samples), min_similarity=0.8, iterations=5), samples


@query()
def greedy_cluster(spark, d):
    """One round at the first threshold: the mapping from k-mers to clusters."""
    dense, samples = _vectors(spark, d)
    v = _kept(dense.select(F.col("kmer").alias("cluster_id"), "values", F.lit(1).cast("long").alias("n")))
    merged = clustering.merge_round(v, 0.95, n=v.count(), dim=len(samples), seed=1, bucket_threshold=20_000)
    return merged.select(F.col("old_id").alias("feature"), "cluster_id")


@query()
def cluster_rounds(spark, d):
    clusters, _, _ = _clustered(spark, d)
    return clusters.select("cluster_id", "n", r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), "total"))


@query()
def cluster_members(spark, d):
    return _clustered(spark, d)[1]


@query()
def cluster_filter(spark, d):
    clusters, _, _ = _clustered(spark, d)
    return clusters.where("n > 5").select("cluster_id", "n")


@query()
def cluster_test(spark, d):
    clusters, _, samples = _clustered(spark, d)
    n1 = sum(s < tables.GROUP_A for s in samples)
    return clustering.test_clusters(clusters, n1, len(samples) - n1, size_threshold=5).select("cluster_id", "n", r6(F.col("t"), "t"), r6(F.col("p_left"), "p_left"), "grp")


# --- extraction -------------------------------------------------------------------------------------------------------

_MARK = f"{_READS}, {_WINDOWS}, wk AS (SELECT sample_id, read_no, {_CANON} AS kmer FROM windows), wp AS (SELECT sample_id, read_no, CAST({_PACK.format('kmer')} AS BIGINT) AS p FROM wk)"


def _marked(spark, d, rest):
    return C.universe(_counts(spark, d, 1)).where(F.col("kmer") % 3 == rest)


@query(f"WITH {_MARK} SELECT wp.sample_id, wp.read_no, count(*) AS n_kmers, count(*) FILTER (p % 3 = 0) AS hits, {_R('count(*) FILTER (p % 3 = 0) / count(*)')} AS ratio FROM wp JOIN reads ON wp.read_no = reads.read_no AND length(seq) >= {K + 10} GROUP BY ALL")
def read_vote(spark, d):
    return X.votes(_reads(spark, d), _marked(spark, d, 0), K).select("sample_id", "read_no", "n_kmers", "hits", r6(F.col("ratio"), "ratio"))


_WON = f"{_MARK}, won AS (SELECT wp.sample_id, wp.read_no FROM wp JOIN reads ON wp.read_no = reads.read_no AND length(seq) >= {K + 10} GROUP BY ALL HAVING count(*) FILTER (p % 3 = CASE WHEN wp.sample_id < 10 THEN 0 ELSE 1 END) / count(*) > 0.35)"


def _extracted(spark, d):
    rest = F.col("kmer") % 3
    classes = C.universe(_counts(spark, d, 1)).where(rest < 2).withColumn("grp", F.when(rest == 0, "A").otherwise("B"))
    groups = spark.createDataFrame([(s, "A" if s < tables.GROUP_A else "B") for s in _samples(spark, d)], "sample_id int, grp string")
    return X.extract(_reads(spark, d), groups, classes, K, 0.35)


@query(f"WITH {_WON} SELECT sample_id, read_no, CASE WHEN sample_id < 10 THEN 'A' ELSE 'B' END AS grp FROM won")
def extract_reads(spark, d):
    return _extracted(spark, d).select("sample_id", "read_no", "grp")


_TESTED = f"""WITH {_TTEST}, cl AS (SELECT kmer, CASE WHEN p_left <= 0.01 THEN 'B' ELSE 'A' END AS grp FROM tp WHERE p_left <= 0.01 OR 1 - p_left <= 0.01)
  SELECT windows.sample_id, windows.read_no, CASE WHEN windows.sample_id < 10 THEN 'A' ELSE 'B' END AS grp FROM windows JOIN reads ON windows.read_no = reads.read_no AND length(seq) >= {K + 10}
  LEFT JOIN cl ON cl.kmer = {_CANON} AND cl.grp = CASE WHEN windows.sample_id < 10 THEN 'A' ELSE 'B' END GROUP BY ALL HAVING count(cl.kmer) / count(*) > 0.005"""


@query(_TESTED)
def tested_reads(spark, d):
    """From texts to reads: counts, two-sample test of each k-mer, and the reads that vote for their group's k-mers."""
    classes = M.ttest(*_moments(spark, d)).where("grp IS NOT NULL").select("kmer", "grp")
    groups = spark.createDataFrame([(s, "A" if s < tables.GROUP_A else "B") for s in _samples(spark, d)], "sample_id int, grp string")
    return X.extract(_reads(spark, d), groups, classes, K, 0.005).select("sample_id", "read_no", "grp")


@query(f"WITH {_WON} SELECT won.read_no, md5('@doc' || CAST(won.read_no AS VARCHAR) || chr(10) || seq || chr(10) || '+' || chr(10)) AS digest FROM won JOIN reads USING (read_no)")
def extract_fastq(spark, d):
    return _extracted(spark, d).select("read_no", F.md5(files.fastq_lines()).alias("digest"))


@query(f"""WITH {_C2}, f AS (SELECT kmer, (row_number() OVER (ORDER BY kmer) - 1) % 50 AS cluster_id FROM feats),
  g AS (SELECT item_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{tables.LETTERS}', '{tables.AS_BASES}') AS seq FROM benchmark),
  gk AS (SELECT DISTINCT item_id, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT item_id, substr(seq, i, {K}) AS w FROM (SELECT *, unnest(range(1, length(seq) - {K - 2})) AS i FROM g)))
  SELECT item_id AS genome, cluster_id, count(*) AS shared FROM gk JOIN f USING (kmer) GROUP BY ALL""")
def genome_quant(spark, d):
    """Benchmark items as genomes; features in 50 given clusters."""
    features = _kept(C.features(_counts(spark, d)))
    members = features.select("feature_id", (F.col("feature_id") % 50).alias("cluster_id"))
    items = tables.text_reads(tables.read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("src0").alias("source")))
    genomes = C.read_kmer_counts(items, K).select(F.col("read_no").alias("genome"), "kmer")
    return X.genome_quant(members, features, genomes)
