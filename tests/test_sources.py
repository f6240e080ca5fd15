"""File sources and sinks: any split gives the same rows, written files read back equal, filters reach the scan."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillmer.functions import seq
from quillmer.sources import fastx, kmerdb
from quillmer.sources.fastx import read_fastx, read_range, ranges, records

MULTI = "@r1 first\nACGT\nAC\n+\nIIII\n@I\n@r2\nGG\n+r2\n@@\n"


def bgzf(data: bytes, size: int) -> bytes:
    """``data`` in gzip blocks of ``size`` bytes of text that give their size, and an empty one at the end."""
    out = b""
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def rows(path, split_bytes):
    return [tuple(x.values()) for r in ranges([str(path)], split_bytes) for b in read_range(r) for x in b.to_pylist()]


def fastq(r: random.Random, n: int) -> str:
    """Records whose names and qualities begin with every mark."""
    out = []
    for i in range(n):
        m = r.choice([0, 1, 2, 3, 8, 30])
        out.append("@" + r.choice(["r", "@", "+x", ""]) + f"{i} d\n" + "".join(r.choice("ACGTN") for _ in range(m)) + "\n+" + r.choice(["", "r"]) + "\n" + "".join(r.choice("@+>!IJ~") for _ in range(m)) + "\n")
    return "".join(out)


@pytest.mark.parametrize("change", ["none", "carriage returns", "no last line end", "truncated"])
def test_any_split_of_a_fastq_file_gives_the_same_rows(tmp_path, change):
    r = random.Random(change)
    for t in range(12):
        text = fastq(r, r.randint(0, 40))
        text = {"none": text, "carriage returns": text.replace("\n", "\r\n"), "no last line end": text[:-1], "truncated": text[: -r.randint(1, 20)]}[change]
        path = tmp_path / f"{t}.fq"
        path.write_bytes(text.encode())
        whole = rows(path, 0)
        assert [x[2:] for x in whole] == list(records(iter(text.splitlines(keepends=True))))
        assert all(text.encode()[x[1] : x[1] + 1] == b"@" for x in whole)
        for split in (1, 3, 7, 20, 64, 500, 10**6):
            assert rows(path, split) == whole
        zipped = tmp_path / f"{t}.fq.gz"
        zipped.write_bytes(bgzf(text.encode(), r.choice([5, 17, 100, 5000])))
        blocks = rows(zipped, 0)
        assert [x[2:] for x in blocks] == [x[2:] for x in whole]
        for split in (1, 30, 100, 1000):
            assert rows(zipped, split) == blocks
        stream = tmp_path / f"{t}.one.gz"
        stream.write_bytes(gzip.compress(text.encode()[:30]) + gzip.compress(text.encode()[30:]))
        assert rows(stream, 5) == whole


def test_any_split_of_a_fasta_file_gives_the_same_rows(tmp_path):
    r = random.Random(9)
    for t in range(20):
        text = "".join(f">s{i} x\n" + "".join("".join(r.choice("ACGT") for _ in range(r.randint(0, 9))) + "\n" for _ in range(r.randint(0, 4))) for i in range(r.randint(1, 30)))
        path = tmp_path / f"{t}.fa"
        path.write_text(text)
        assert [x[2:] for x in rows(path, 0)] == list(records(iter(text.splitlines(keepends=True))))
        for split in (1, 2, 9, 50, 1000):
            assert rows(path, split) == rows(path, 0)


def test_other_forms_are_read_whole_or_refused(tmp_path):
    (tmp_path / "m.fq").write_text(MULTI * 5)
    assert len(ranges([str(tmp_path / "m.fq")], 3)) == 1 and len(rows(tmp_path / "m.fq", 3)) == 10
    (tmp_path / "mixed.fq").write_text("".join(f"@q{i}\n{'ACGT' * 25}\n+\n{'IJKL' * 25}\n" for i in range(5000)) + MULTI)
    assert len(rows(tmp_path / "mixed.fq", 0)) == 5002
    with pytest.raises(ValueError, match="split_bytes=0"):
        rows(tmp_path / "mixed.fq", 100_000)


def test_reads_of_folders_keep_distinct_places(spark, tmp_path):
    for sample in ("one", "two"):
        (tmp_path / sample).mkdir()
        for k in range(3):
            (tmp_path / sample / f"part-{k}.fq").write_text(fastq(random.Random(k), 50))
        (tmp_path / sample / "_SUCCESS").write_text("")
    paths = [str(tmp_path / "one"), "file://" + str(tmp_path / "two")]
    got = read_fastx(spark, paths, 200)
    assert got.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read_fastx(spark, paths, 0).collect()))
    assert got.count() == 300 and got.select("sample_id", "read_no").distinct().count() == 300
    assert [r.seq for r in got.where("sample_id = 1").orderBy("read_no").collect()] == [s for k in range(3) for _, s, _ in records(iter(fastq(random.Random(k), 50).splitlines(keepends=True)))]


@pytest.fixture
def counts(spark):
    r = random.Random(4)
    return spark.createDataFrame([(x, 1 + x % 300) for x in {r.randrange(4**13) for _ in range(5000)}], "kmer long, cnt long")


def test_database_folder_round_trip(spark, counts, tmp_path):
    path = str(tmp_path / "db")
    kmerdb.write_kmerdb(counts, path, 13, counter_size=2, files=4)
    assert len(kmerdb.pairs(path)) == 4 and not list(tmp_path.glob("db/_temporary*"))
    assert sorted(map(tuple, kmerdb.read_kmerdb(spark, path, records=700).collect())) == sorted(map(tuple, counts.collect()))
    assert sum(kmerdb.header((tmp_path / f"db/{p.split('/')[-1]}.kmc_pre").read_bytes())["total_kmers"] for p in kmerdb.pairs(path)) == counts.count()
    kmerdb.write_kmerdb(counts.limit(10), path, 13)
    assert kmerdb.read_kmerdb(spark, path).count() == 10
    kmerdb.write_kmerdb(counts.where("false"), path, 13)
    assert kmerdb.read_kmerdb(spark, path).count() == 0


def test_bounds_are_pushed_into_the_scan(spark, counts, tmp_path, capsys):
    path = str(tmp_path / "db")
    kmerdb.write_kmerdb(counts, path, 13, files=3)
    some = counts.first().kmer
    for condition in ("cnt BETWEEN 5 AND 9", "cnt = 7 AND kmer > 1000000", f"kmer = {some}", "kmer < 5000000 AND cnt >= 290", "kmer > 67108864", "cnt < 0", "cnt IN (3, 4)", "kmer + cnt > 66000000"):
        scan = kmerdb.read_kmerdb(spark, path, records=500).where(condition)
        assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, counts.where(condition).collect())), condition
    kmerdb.read_kmerdb(spark, path).where("cnt BETWEEN 5 AND 9").explain()
    assert "Filter" not in capsys.readouterr().out.split("BatchScan")[0].replace("PushedFilters", "")


def test_a_point_lookup_reads_one_prefix(counts, spark, tmp_path):
    kmerdb.write_kmerdb(counts.coalesce(1), str(tmp_path / "db"), 13)
    some = counts.first().kmer
    spans = [db.narrowed(some, some) for db in map(kmerdb.Database, kmerdb.pairs(str(tmp_path / "db")))]
    assert 1 <= sum(b - a for a, b in spans) < 30  # 1,024 prefixes of 5,000 k-mers
    assert kmerdb.Database(kmerdb.pairs(str(tmp_path / "db"))[0]).narrowed(0, 4**13) != (0, 0)


def test_a_failed_write_leaves_no_part(spark, counts, tmp_path):
    path = str(tmp_path / "db")
    kmerdb.write_kmerdb(counts.limit(20), path, 13)
    kmerdb.register(spark)
    twice = counts.union(counts).repartitionByRange(3, "kmer").sortWithinPartitions("kmer")
    with pytest.raises(Exception, match="distinct and sorted"):
        twice.write.format("kmerdb").options(path=path, k=13, prefix=5).mode("overwrite").save()
    assert not list(tmp_path.glob("db/_temporary*")) and kmerdb.read_kmerdb(spark, path).count() == 20


def test_databases_with_signatures_and_other_counters(spark, tmp_path):
    """A database of two bins by hand: k 5, prefix 1, float counters; k-mers are in order within a bin."""
    bins = [{0: 2.0, 300: 5.0}, {1: 7.0, 1023: 3.0}]
    starts, body, total = [], b"", 0
    for b in bins:
        for p in range(4):
            starts.append(total)
            for x in sorted(b):
                if x >> 8 == p:
                    body += bytes([x & 255]) + struct.pack("<f", b[x])
                    total += 1
    head = struct.pack("<IIIIIIIQ?", 5, 1, 4, 1, 3, 1, 1000, total, False)
    head += struct.pack("<I", kmerdb.VERSION_SIGNATURES)
    pre = b"KMCP" + struct.pack("<9Q", *starts, total) + bytes(4 * (4**3 + 1)) + head + struct.pack("<I", len(head)) + b"KMCP"
    (tmp_path / "s.kmc_pre").write_bytes(pre)
    (tmp_path / "s.kmc_suf").write_bytes(b"KMCS" + body + b"KMCS")
    for records_ in (1, 2, 100):
        got = kmerdb.read_kmerdb(spark, str(tmp_path / "s"), records=records_)
        assert sorted(map(tuple, got.collect())) == [(0, 2), (1, 7), (300, 5), (1023, 3)]
        assert sorted(map(tuple, got.where("kmer >= 300 AND cnt < 5").collect())) == [(1023, 3)]


def test_kmers_as_text_of_a_scan(spark, counts, tmp_path):
    kmerdb.write_kmerdb(counts, str(tmp_path / "db"), 13)
    texts = kmerdb.read_kmerdb(spark, str(tmp_path / "db")).select(seq.decode(F.col("kmer"), 13).alias("t"))
    assert texts.where("length(t) <> 13").count() == 0


def test_registered_form_of_places(tmp_path):
    (tmp_path / "a.fq").write_text(fastq(random.Random(1), 3))
    assert fastx.form_of(str(tmp_path / "a.fq"))[:2] == ("plain", False) and fastx.form_of("file://" + str(tmp_path / "a.fq"))[0] == "plain"


def test_a_stream_of_growing_files_restarts_where_it_stopped(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    texts = [fastq(random.Random(k), 60) for k in range(3)]
    half = len(texts[1]) // 2  # in the middle of a record

    def run():
        q = fastx.stream_fastx(spark, str(folder), sample_id=4, split_bytes=400).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).start(out)
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out).count()

    (folder / "a.fq").write_text(texts[0])
    (folder / "b.fq").write_text(texts[1][:half])
    first = run()
    assert 60 < first < 120
    assert run() == first
    (folder / "b.fq").write_text(texts[1])
    (folder / "c.fq").write_text(texts[2])
    assert run() == 180
    got = sorted(tuple(r)[2:] for r in spark.read.parquet(out).collect())
    assert got == sorted(x for t in texts for x in records(iter(t.splitlines(keepends=True))))
    assert spark.read.parquet(out).where("sample_id <> 4").isEmpty()


def test_whole_records_of_a_growing_file(tmp_path):
    text = fastq(random.Random(8), 30)
    ends = {0}
    lines, at = text.split("\n"), 0
    for k in range(0, len(lines) - 1, 4):
        at += sum(map(len, lines[k : k + 4])) + 4
        ends.add(at)
    for n in range(0, len(text) + 1, 7):
        (tmp_path / "g.fq").write_text(text[:n])
        assert fastx.complete(str(tmp_path / "g.fq")) == max(e for e in ends if e <= n)
