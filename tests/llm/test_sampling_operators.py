"""Importance resampling, SentencePiece coding and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmer.llm import hard_negatives, importance, piece_bpe
from quillmer.llm.common import table
from quillmer.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5, min_words=20):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text) row by the definition."""
    s, t, rows = [0] * 10000, [0] * 10000, []
    for i, text in docs:
        n, f = features(text)
        b = [zlib.crc32(x.encode()) % 10000 for x in f]
        rows.append((i, n, b))
        for x in b:
            s[x] += 1
    for text in target:
        for x in features(text)[1]:
            t[zlib.crc32(x.encode()) % 10000] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in range(10000)]
    out = []
    for i, n, b in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < len(fit) * percent // 100 else None)
    return sorted(repr((r[0], r[1], r[2], r[3], r[5] if r[4] else None)) for r in out)


def test_resampling_equals_brute_force(spark, sf):
    got = QUERIES["op11_importance_resampling"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == resampled(docs, target)


def test_resampling_of_odd_rows(spark, odd, empty, long_text):
    extra = spark.createDataFrame([(77, long_text), (78, "x " * 30), (79, "two words"), (80, "y")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = importance.resample(docs, extra, percent=50, min_words=5).collect()
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in extra.collect()], 50, 5)
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == want
    assert importance.resample(empty, extra).count() == 0
    alone = importance.resample(odd, empty.withColumnRenamed("doc_id", "item_id"), percent=100, min_words=1).collect()
    assert len(alone) == odd.count() and sum(r["rank"] is not None for r in alone) == 6


def test_small_blocks_and_parts_give_the_same_weights(spark, sf, monkeypatch):
    docs, target = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = sorted(map(tuple, importance.weights(docs, target).collect()))
    monkeypatch.setattr(importance, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(importance, "parts_of", lambda t: 17)
    assert sorted(map(tuple, importance.weights(docs.repartition(3), target).collect())) == want


def test_dictionary_holds_each_feature_once(spark):
    docs = spark.createDataFrame([(1, "A b a b"), (2, "a b"), (3, None), (4, "Ünï a")], "doc_id long, text string")
    got = {r.feature: (r.n, r.bucket) for r in importance.dictionary(docs).collect()}
    counted = {}
    for t in ("A b a b", "a b", "Ünï a"):
        for f in features(t)[1]:
            counted[f] = counted.get(f, 0) + 1
    assert got == {f: (n, zlib.crc32(f.encode()) % 10000) for f, n in counted.items()}


def test_dictionary_shuffles_runs_not_features(spark):
    """These texts of 3 MB shuffled 2.11 bytes a byte of text when each feature was dealt out and its bucket sent back, and 1.28 as runs."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("an the ion re st ed ou nt ha ly er wh ea or".split()) for _ in range(r.randint(1, 4))) for _ in range(20_000)]
    texts = [" ".join(vocabulary[int(20_000 * r.random() ** 3)] for _ in range(200)) for _ in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    target = spark.createDataFrame([("a b c",)], "text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    importance.weights(docs, target)
    assert 0 < written() - before < 1.6 * sum(map(len, texts))


def test_sums_of_many_parts_make_no_more_rows(spark):
    sums = [[(p * b) % 7 for b in range(50)] for p in range(1, 101)]
    found = spark.createDataFrame([(p, None, s) for p, s in enumerate(sums)] + [(0, 1, None)], "part int, block long, sums array<long>").repartition(40)
    got = {r["bucket"]: r["n"] for r in importance.bucket_sums(found).collect()}
    assert got == {b: n for b, n in enumerate(map(sum, zip(*sums))) if n}
    assert importance.bucket_sums(found.where("sums IS NULL")).count() == 0


def test_features_go_to_one_part_whatever_block_holds_them(spark, monkeypatch):
    """Owners, wide and narrow ones, and words that are common in one block alone."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "c", f"w{r.randrange(30)}", f"x{r.randrange(400)}"]) for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(importance, "parts_of", lambda t: 9)
    counted = {}
    for t in texts:
        for f in features(t)[1]:
            counted[f] = counted.get(f, 0) + 1
    got = importance.dictionary(docs).collect()
    assert len(got) == len(counted) and {x.feature: (x.n, x.bucket) for x in got} == {f: (n, zlib.crc32(f.encode()) % 10000) for f, n in counted.items()}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))


def test_pieces_equal_the_library_on_random_texts(library):
    c, r = piece_bpe.coder(), random.Random(5)
    pieces, letters = list(c.piece.values()), "aabcdeth  ▁\n\t.,-012éü中文😀\x00"
    for k in range(20_000):
        if k % 3 == 0:
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        elif k % 3 == 1:
            t = "".join(r.choice(pieces) for _ in range(r.randint(1, 6))).replace("▁", " ")
        else:
            t = r.choice(["a", "ab", "th", "ing", " ", "   ", "\n"]) * r.randint(1, 30) + "".join(r.choice(letters) for _ in range(r.randint(0, 10)))
        assert np.frombuffer(c.encode(t), "<i4").tolist() == library.encode(t), repr(t)


def test_pieces_of_one_long_word_take_linear_time(library):
    r = random.Random(6)
    for t in ("".join(r.choice("abcdefghij") for _ in range(300_000)), "a" * 200_000 + " " * 100_000, "中" * 50_000):
        assert np.frombuffer(piece_bpe.coder().encode(t), "<i4").tolist() == library.encode(t)


def test_pieces_of_documents(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_sentencepiece"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        assert got[d.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_odd_rows(spark, odd, empty, library):
    docs = odd.withColumn("given", F.lit(3)).withColumn("a.b", F.lit("z"))
    coded = piece_bpe.encode(docs)
    assert coded.columns == [*docs.columns, "ids"]
    back = piece_bpe.decode(coded, out="again").collect()
    assert len(back) == docs.count()
    for r in back:
        assert r["ids"] == library.encode(r["text"] or "") and r["again"] == (r["text"] or "") and r["given"] == 3
    assert piece_bpe.report(empty).count() == 0
    assert piece_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).select("text").collect() == [("",), ("",)]


def mined(rows, k=5, low=80, high=100):
    """Brute force over (vec_id, label, vector) rows; vec_id divisible by 100 is an anchor."""
    fit = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in (r for r in fit if r[0] % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in fit]
        for p, j, _ in sorted(s for s in scored if s[2] == y and s[1] != i)[:k]:
            hard = sorted(s for s in scored if s[2] != y and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(i, j, n + 1, m, -p, -q) for n, (q, m, _) in enumerate(hard)]
    return sorted(out)


def test_negatives_with_ties_and_odd_rows(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(3), [r.choice([0.1, 0.2, 0.3, -0.05]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, i % 3, [0.3, 0.3, 0.3, 0.3]) for i in range(500)]  # hundreds of equal scores
    rows += [(2000, None, [1.0] * 4), (2100, 1, None), (2200, 1, [1.0, None, 1.0, 1.0]), (2300, 1, [1.0, float("nan"), 1.0, 1.0]), (2400, 1, [float("inf")] * 4), (2500, 2, [-0.5] * 4), (None, 1, [0.3] * 4), (-100, 1, [0.2] * 4), (2600, 0, [0.4, 0.2]), (2700, 9, [0.3] * 4), (2800, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    exact = [(x.vec_id, x.label, x.embedding) for x in df.collect()]
    got = hard_negatives.mine(df.withColumn("score", F.lit("x")).withColumn("v", F.lit("x")), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined(exact)
    small = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, block=3)
    assert sorted(map(tuple, small.collect())) == mined(exact)
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_negatives_of_large_components_are_exact(spark):
    rows = [(i * 50, i % 2, [1e5 + i, 3e5 - 7 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == mined(rows)
    with pytest.raises(ValueError):
        hard_negatives.mine(df.withColumn("embedding", F.array(F.lit(1e20))), F.col("vec_id") % 100 == 0)
