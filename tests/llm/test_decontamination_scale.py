"""Decontamination on repeated words, shared windows, many blocks and large items, against brute force."""

import random
import time

from quillmer.llm import decontam_wm as wm


def brute(docs, items, length=13):
    """(n_hit, items) of each document of words."""
    out = []
    for d in docs:
        hit, found = set(), set()
        for name, w in items:
            m = min(length, len(w))
            windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
            for i in range(len(d) - m + 1):
                if tuple(d[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add(name)
        out.append((len(hit), sorted(found)))
    return out


def searched(docs, items):
    known = wm.searchers([(name, " ".join(w).encode()) for name, w in items])
    out = []
    for d in docs:
        spans, names = [], set()
        for s in known:
            ends = []
            s.find([x.encode() for x in d], ends, names)
            spans += [(e - s.m, e) for e in ends]
        flat = wm.merge(spans)
        out.append((sum(flat[1::2]) - sum(flat[::2]), sorted(names)))
    return out


def texts(r, n, letters, longest):
    return [[r.choice(letters) for _ in range(r.randint(0, longest))] for _ in range(n)]


def test_small_alphabets_equal_brute_force():
    r = random.Random(1)
    for letters in ("a", "ab", "abc"):
        items = [(f"i{k % 7}", w) for k, w in enumerate(texts(r, 20, letters, 25))]
        docs = texts(r, 20, letters, 60) + [w * 2 for _, w in items]
        assert searched(docs, items) == brute(docs, items)


def test_repeated_words_take_linear_time():
    words = [b"a"] * 100_000
    began = time.perf_counter()
    (s,) = wm.searchers([("x", b" ".join(words))])
    ends, names = [], set()
    s.find(words, ends, names)
    assert len(ends) == 100_000 - 12 and names == {"x"} and len(s.place) == 1
    assert time.perf_counter() - began < 10


def test_thousands_of_items_that_share_windows():
    common = [f"c{k}" for k in range(30)]
    items = [(f"i{k}", [f"u{k}", *common]) for k in range(10_000)]
    began = time.perf_counter()
    got = searched([common * 50, [*common[:13], "x"], ["u5", *common[:12]]], items)
    assert [n for n, _ in got] == [1500, 13, 13] and [len(x) for _, x in got] == [10_000, 10_000, 1]
    assert time.perf_counter() - began < 20


def test_windows_alike_at_both_ends():
    items = [(f"i{k}", ["a", "b", *[f"m{k}"] * 9, "y", "z"]) for k in range(5000)]
    began = time.perf_counter()
    docs = [[*w, "q"] for _, w in items[:2000]]
    assert searched(docs, items) == [(13, [name]) for name, _ in items[:2000]]
    assert time.perf_counter() - began < 10


def test_blocks_and_pieces_give_the_same_rows(spark, odd, monkeypatch):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts(r, 60, "abcd", 80))] + [(1, None), (None, "a b")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(f"i{k % 30}", " ".join(w)) for k, w in enumerate(texts(r, 40, "abcd", 40))] + [("long", " ".join(r.choice("abcd") for _ in range(400))), (None, "b a b"), ("none", None)], "item_id string, text string")
    rows = lambda **args: sorted(map(repr, wm.report(docs, items, **args).collect()))
    want = rows()
    assert rows(block_bytes=200) == want
    monkeypatch.setattr(wm, "PIECE_WORDS", 16)
    assert rows() == want and rows(block_bytes=300) == want
    kept = wm.decontaminate(odd, items, block_bytes=100)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, wm.decontaminate(odd, items).collect()))
