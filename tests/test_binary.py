"""Binary rows and cluster pairs: windows read their own bytes, written files read back equal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmer.sources import binary
from quillmer.sources.places import files_of


def test_rows_by_window(spark, tmp_path):
    (tmp_path / "d").mkdir()
    parts = [np.arange(0, 30, dtype="<u2").reshape(10, 3), np.arange(100, 121, dtype="<u2").reshape(7, 3)]
    for k, x in enumerate(parts):
        (tmp_path / "d" / f"p{k}.bin").write_bytes(x.tobytes())
    want = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate(parts))]
    got = lambda **o: sorted(map(tuple, binary.read_rows(spark, str(tmp_path / "d"), "<u2", 3, **o).collect()))
    for rows in (1, 4, 100):
        assert got(rows=rows) == want
        assert got(rows=rows, start=8, num=5) == want[8:13]
    assert got(start=50, num=2) == [] and got(start=16, num=9) == want[16:]
    scan = binary.read_rows(spark, str(tmp_path / "d"), "<u2", 3, rows=2)
    assert [r.row_id for r in scan.where("row_id > 8 AND row_id <= 11").orderBy("row_id").collect()] == [9, 10, 11]
    assert scan.where("row_id = 12").first()["values"] == want[12][1]
    assert len(binary._Rows({"path": str(tmp_path / "d"), "type": "<u2", "width": "3", "start": "9", "num": "2", "rows": "1"}).partitions()) == 2


@pytest.fixture
def clusters(spark):
    r = np.random.default_rng(3)
    sizes = [int(x) for x in r.integers(1, 40, 60)] + [300]
    c = spark.createDataFrame([(10 * i, [float(x) for x in r.normal(size=4).astype("<f4")], n) for i, n in enumerate(sizes)], "cluster_id long, values array<double>, n long")
    m = spark.createDataFrame([(10 * i, 100_000 * i + k * k) for i, n in enumerate(sizes) for k in range(n)], "cluster_id long, feature_id long")
    return c, m


@pytest.mark.parametrize("files", [1, 4])
def test_cluster_pairs_round_trip(spark, clusters, tmp_path, files):
    c, m = clusters
    path = str(tmp_path / "pair")
    binary.write_clusters(c, m.repartition(3), path, files=files)
    kept = c.where("n > 5").orderBy("cluster_id").collect()
    assert len([f for f in files_of(path) if f.endswith(".bin")]) in range(min(2, files), files + 1) and not list(tmp_path.glob("pair/_temporary*"))
    centres = binary.read_clusters(spark, path, "centroids", 4, rows=7).orderBy("row_id").collect()
    assert [r["values"] for r in centres] == [r["values"] for r in kept] and [r.row_id for r in centres] == list(range(len(kept)))
    ids = {r.cluster_id: i for i, r in enumerate(kept)}
    want = sorted((ids[r.cluster_id], r.feature_id) for r in m.collect() if r.cluster_id in ids)
    assert sorted(map(tuple, binary.read_clusters(spark, path, "members", 4, rows=7).collect())) == want
    window = binary.read_clusters(spark, path, "members", 4, start=5, num=9)
    assert sorted(map(tuple, window.collect())) == [w for w in want if 5 <= w[0] < 14]
    assert binary.read_clusters(spark, path, "members", 4, rows=3).where("row_id = 2").count() == kept[2].n
    text = "".join((tmp_path / "pair" / f.rsplit("/", 1)[1]).read_text() for f in files_of(path) if f.endswith(".clust"))
    assert [int(x.split("\t")[0]) for x in text.splitlines()] == [r.n for r in kept] == [len(x.split("\t")) - 1 for x in text.splitlines()]


def test_cluster_pairs_of_nothing_and_of_a_failed_task(spark, clusters, tmp_path):
    c, m = clusters
    path = str(tmp_path / "pair")
    binary.write_clusters(c, m, path)
    n = binary.read_clusters(spark, path, "centroids", 4).count()
    bad = c.withColumn("values", F.when(F.col("cluster_id") == 600, F.array(F.expr("CAST(raise_error('broken') AS DOUBLE)"))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="broken"):
        binary.write_clusters(bad, m, path, files=3)
    assert binary.read_clusters(spark, path, "centroids", 4).count() == n and not list(tmp_path.glob("pair/_temporary*"))
    binary.write_clusters(c.where("false"), m, path)
    assert binary.read_clusters(spark, path, "centroids", 4).count() == 0 == binary.read_clusters(spark, path, "members", 4).count()
