"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark items' windows of 13 consecutive words (an item of fewer words is one window), each distinct window
once with all its items. A shift table over blocks of two words tells how far a position can move on when no window ends there; where the
shift is zero, the hash of the window's last block selects a bucket, the hash of all its words a part of it, and the words are compared directly.
Windows of one length form one searcher, since the shift of a searcher is bounded by its shortest pattern. A document reports
each set of items once, however often their windows occur in it.

The windows are broadcast in blocks of items whose text size has been counted; items that are larger go in overlapping pieces. A benchmark of more
than one block is searched block by block: the documents are written once with a number, each block adds a narrow table of the rows
in which it found something, and these are added up by that number.

Defined results: a null text, document or item, has no words; a document without words is clean; items without words are
never found; items that share an id count as one, a null item_id reads as an empty string; repeated document rows each get
their row; an empty table gives no rows, an empty benchmark finds nothing; extra columns are ignored or kept untouched.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col, discard, fresh_name, materialize, text_bytes

WINDOW = 13
#: bytes of benchmark text that are broadcast together; their tables take about 40 bytes for each in a worker, 170 MB
BLOCK_BYTES = 4 * 1024 * 1024
#: a document is contaminated from this share of hit words
MIN_HIT_SHARE = 1 / 20

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8: runs of ASCII letters and digits and of all code points from U+0080."""
    return text.translate(_TO_WORDS).split()


class Searcher:
    """Wu-Manber tables for windows of one length: the words of distinct texts and the windows' places in them.

    Shifts are kept by the block's hash, where blocks that meet only shorten a shift. Distinct windows are chained by the hash of their
    last block and of all their words, and point into the words of a text, which are compared directly. ``owners`` holds the sets of
    items that windows have in common, each once.
    """

    def __init__(self, length: int, texts: list[tuple[tuple[str, ...], list[bytes]]]):
        self.m = length
        self.b = b = min(2, length)
        self.words = [w for _, w in texts]
        windows = sum(len(w) - length + 1 for w in self.words)
        self.mask = (1 << max(10, (4 * windows).bit_length())) - 1
        self.shift = bytearray([length - b + 1]) * (self.mask + 1)
        self.head: dict[int, int] = {}
        self.next, self.place, owner = array("q"), array("q"), array("q")
        sets: dict[tuple[int, int], int] = {}  # (set, text added to it) -> set; set 0 is empty
        members: list[tuple[int, int]] = [(0, -1)]  # the set before and the text added
        shift, mask = self.shift, self.mask
        for t, w in enumerate(self.words):
            last = len(w) - length
            for k in range(len(w) - b + 1):
                step = max(0, length - b - k)  # its least distance from the end of a window that holds it
                at = hash(tuple(w[k : k + b])) & mask
                if step < shift[at]:
                    shift[at] = step
            for k in range(last + 1):
                window = w[k : k + length]
                at = self.find_window(window)
                if at < 0:
                    key = self._key(window)
                    self.next.append(self.head.get(key, -1))
                    self.head[key] = at = len(self.place)
                    self.place.append(t << 32 | k)
                    owner.append(0)
                now = owner[at]
                if members[now][1] != t:  # texts come one after another, so the last one added tells
                    if (now, t) not in sets:
                        sets[now, t] = len(members)
                        members.append((now, t))
                    owner[at] = sets[now, t]
        self.owner, self.members, self.items = owner, members, [items for items, _ in texts]

    def _key(self, window: list[bytes]) -> int:
        return hash((*window[-self.b :], hash(tuple(window))))

    def find_window(self, window: list[bytes]) -> int:
        """Number of a distinct window, -1 if there is none."""
        at = self.head.get(self._key(window), -1)
        while at >= 0:
            t, k = self.place[at] >> 32, self.place[at] & 0xFFFFFFFF
            if self.words[t][k : k + self.m] == window:
                break
            at = self.next[at]
        return at

    def find(self, words: list[bytes], ends: list[int], items: set[str]) -> None:
        """Append the end of each occurrence, in order, and add the items that it belongs to."""
        m, b, shift, mask, found, owner, members = self.m, self.b, self.shift, self.mask, self.find_window, self.owner, self.members
        i, n, seen = m, len(words), {0}
        while i <= n:
            step = shift[hash((words[i - 2], words[i - 1]) if b == 2 else (words[i - 1],)) & mask]
            if step:
                i += step
                continue
            at = found(words[i - m : i])
            if at >= 0:
                ends.append(i)
                now = owner[at]
                while now not in seen:  # a set is the one before and a text
                    seen.add(now)
                    now, t = members[now]
                    items.update(self.items[t])
            i += 1


def searchers(items: list[tuple[str, bytes]]) -> list[Searcher]:
    known: dict[bytes, bytes] = {}  # each word once
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item, text in items:
        w = tuple(known.setdefault(x, x) for x in words_of(text))
        if w:
            by_length.setdefault(min(WINDOW, len(w)), {}).setdefault(w, set()).add(item)
    return [Searcher(m, [(tuple(ids), list(w)) for w, ids in texts.items()]) for m, texts in sorted(by_length.items())]


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans, flattened, that cover the same words."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
_built: dict[str, list[Searcher]] = {}


def _search_udf(block) -> Callable:
    @F.pandas_udf(_FOUND)
    def search(text: pd.Series) -> pd.DataFrame:
        if block.id not in _built:
            _built.clear()
            _built[block.id] = searchers(block.value)
        rows = []
        for t in text:
            words, spans, known = words_of(t), [], set()
            for s in _built[block.id]:
                ends: list[int] = []
                s.find(words, ends, known)
                spans += [(e - s.m, e) for e in ends]
            rows.append((len(words), merge(spans), sorted(known)))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return search


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _merge_udf(spans: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else merge(list(zip(x[::2].tolist(), x[1::2].tolist()))) for x in spans])


class _Handle:
    """A broadcast and a number that names it in the workers."""

    def __init__(self, broadcast, number: str):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


#: words of a piece of a large item
PIECE_WORDS = 20_000


def pieces(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, t): the items with text; of long ones overlapping pieces that hold all their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, t in zip(*(c.to_pylist() for c in batch.columns)):
                if len(t) <= 2 * PIECE_WORDS:  # a word and what parts it from the next
                    ids.append(item)
                    texts.append(t)
                    continue
                w = words_of(t)
                for k in range(0, max(1, len(w) - WINDOW + 1), PIECE_WORDS):
                    ids.append(item)
                    texts.append(b" ".join(w[k : k + PIECE_WORDS + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item", "t"])

    return benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), text_bytes(text_col).alias("t")).where("length(t) > 0").mapInArrow(cut, "item string, t binary")


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about ``block_bytes``, by a hash of the item; each is read only when it is asked for."""
    items = pieces(benchmark, item_col, text_col)
    size = items.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k)
        yield [(r.item, bytes(r.t)) for r in part.toLocalIterator()]


def search(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, out: str = "found") -> DataFrame:
    """``docs`` with a further column ``out``: struct of n_words, hits (disjoint spans of hit words, flattened: start, end,
    start, ...) and items (sorted ids of the items with occurring windows)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found_by = lambda block: _search_udf(_Handle(spark.sparkContext.broadcast(block), uuid.uuid4().hex))(text_bytes(text_col))
    each = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(each), next(each, None)
    if second is None:
        return docs.withColumn(out, found_by(first))
    key = fresh_name(docs, "row")
    numbered, _ = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "searched")
    total, path = materialize(numbered.select(key, found_by(first).alias("f")), "found")
    for block in itertools.chain([second], each):
        more = numbered.select(key, found_by(block).alias("g")).where(F.size("g.hits") > 0)
        f, g = F.col("f"), F.col("g")
        merged = F.struct(f["n_words"].alias("n_words"), _merge_udf(F.concat(f["hits"], g["hits"])).alias("hits"), F.array_sort(F.array_union(f["items"], g["items"])).alias("items"))
        # narrow rows: a number, and what was found; rows without more keep theirs
        total, new = materialize(total.join(more, key, "left").select(key, F.when(g.isNull(), f).otherwise(merged).alias("f")), "found")
        discard(spark, path)
        path = new
    return numbered.join(total.withColumnRenamed("f", out), key).drop(key)


def n_hit(found: Column) -> Column:
    """Number of words in the spans of a ``found`` column."""
    return F.aggregate(found["hits"], F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]


def contaminated(found: Column) -> Column:
    hit = n_hit(found)
    return (hit > 0) & (hit * int(1 / MIN_HIT_SHARE) >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **args) -> DataFrame:
    """The rows of ``docs``, columns untouched, that aren't contaminated."""
    out = fresh_name(docs, "found")
    found = search(docs, benchmark, text_col=text_col, out=out, **args)
    return found.where(~contaminated(F.col(out))).select(*[col(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), benchmark, **args)
    f = F.col("found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f["items"]), ","), 256).alias("items_sha256"), contaminated(f).alias("contaminated"),
    )


#: the same results by list functions over whole tables
ORACLE_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bp AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS pattern
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(13, len(w)) AS m FROM bw WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT m FROM bp
), dp AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m)
), hits AS (SELECT doc_id, dp.m, i, item_id FROM dp JOIN bp ON dp.m = bp.m AND dp.pattern = bp.pattern
), n_hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), n_found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n_hits h ON dw.doc_id = h.doc_id LEFT JOIN n_found f ON dw.doc_id = f.doc_id
"""
