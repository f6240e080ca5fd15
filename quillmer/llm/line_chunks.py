"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A rolling hash over the hashes of a line and the one before decides where chunks may end: seven lines in eight may, so
boundaries follow the content and shift with it. A chunk starts at every line and ends at the first boundary after that line,
after MAX_LINES lines or with the text; so chunks have two lines or more and overlap, and what two texts share is cut alike in
both from its first line on. Chunks that occur more than once in the corpus are removed but for their first occurrence, after
their bytes have been compared with it; a line goes when a chunk that goes holds it. Where a chunk overlaps its own first
occurrence (runs of one line), the lines of that occurrence stay. So each line that goes equals one that stays.

What stays of a repeated passage: its last lines, if no boundary follows its last but one; a passage of two lines whose second
is no boundary stays whole.

Only hashes are grouped for all chunks. Neighbouring chunks that repeat neighbouring ones are compared as one stretch, so the
compared texts are about as long as what repeats. Texts move once, by their own key, to meet what repeats in them, and once
more those of documents where something does. These joins always merge: what they join grows with the corpus, so the plan is
the same at every size.

Defined results: a null text is empty, one empty line; the first occurrence is the one in the smallest doc_id (null last),
then text hash, then position; rows equal in doc_id and text are one document and get the same result; a text of one line and
chunks without a word stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, let, materialize

#: lines of a chunk in which no line but the first may end one
MAX_LINES = 8
#: of the rolling hash: hashes below 2**32, times FACTOR, fit in 63 bits; it ends a chunk below ENDS
FACTOR, PRIME = 1_103_515_245, 2_147_483_647
ENDS = PRIME // 8 * 7

KEY = ["none", "doc_id", "th"]


def chunks(text: Column) -> Column:
    """Chunks of a text by their first lines, as structs of k (that line), n (lines), h1, h2 (hashes) and word (has it one?)."""
    hashes = lambda ls: F.transform(ls, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    rolled = lambda h, i: (F.get(h, i) + FACTOR * F.when(i > 0, F.get(h, i - 1)).otherwise(F.lit(0).cast("long"))) % PRIME
    ends = lambda h: F.transform(h, lambda _, i: rolled(h, i) < ENDS)

    def length(e: Column, i: Column) -> Column:
        n = F.when(F.get(e, i + 1), 2)
        for j in range(2, MAX_LINES - 1):
            n = n.when(F.get(e, i + j), j + 1)
        return F.least(n.otherwise(MAX_LINES), F.size(e) - i)

    def chunk(i: Column, n: Column, part: Column) -> Column:
        word = F.exists(part, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(i.alias("k"), n.alias("n"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"), word.alias("word"))

    def each(ls: Column, e: Column) -> Column:
        one = lambda i: let(length(e, i), lambda n: let(F.slice(ls, i + 1, n), lambda part: chunk(i, n, part)))
        return F.transform(F.sequence(F.lit(0), F.size(ls) - 2), one)

    return let(F.split(text, "\n", -1), lambda ls: F.when(F.size(ls) > 1, let(let(hashes(ls), ends), lambda e: each(ls, e))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(col(text_col), F.lit(""))
    return docs.select(col(id_col).isNull().alias("none"), col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["none"].eqNullSafe(b["none"]) & a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _stretches(docs: DataFrame) -> DataFrame:
    """(none, doc_id, th, k, len, start, lead): lines k to k + len - 1 of a document have the hashes of as many from line lead.k of
    the document in ``lead`` on, and the lines from ``start`` on would go. A table."""
    spark = docs.sparkSession
    each = docs.select(*KEY, F.explode(chunks(F.col("t"))).alias("c")).where("c.word").select(*KEY, "c.k", "c.n", "c.h1", "c.h2")
    hashed, path = materialize(each, "chunks")
    first = hashed.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "k")).alias("lead")).where("c > 1").drop("c")
    first, first_path = materialize(first, "first")  # as a table, so that the join may split a chunk that is everywhere
    met = hashed.join(first, ["h1", "h2"]).drop("h1", "h2").where(F.struct(*KEY, "k") != F.col("lead"))
    w = Window.partitionBy(*KEY).orderBy("k")
    own = F.struct(*KEY) == F.struct("lead.none", "lead.doc_id", "lead.th")
    before = F.lag(F.struct("k", "lead")).over(w)
    step = F.col("k") - before["k"]
    follows = (step <= 1) & (F.col("lead.k") - before["lead"]["k"] == step)
    for c in KEY:
        follows = follows & F.col("lead")[c].eqNullSafe(before["lead"][c])
    runs = met.withColumn("own", own).withColumn("new", (F.col("own") | ~F.coalesce(follows, F.lit(False))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("k").alias("k"), (F.max(F.col("k") + F.col("n")) - F.min("k")).alias("len"), F.min("lead").alias("lead"), F.first("own").alias("own"))
    start = F.when(F.col("own"), F.greatest("k", F.col("lead.k") + F.col("len"))).otherwise(F.col("k"))
    found, _ = materialize(runs.select(*KEY, "k", "len", start.alias("start"), "lead"), "stretches")
    discard(spark, path, first_path)
    return found


def _wanted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (none, doc_id, th, t) and wanted: the stretches to compare, as structs of k, len, start and lead; start is
    null in those that others are compared with. Null where there is none. A table."""
    stretches = _stretches(docs)
    ask = stretches.select("lead", "len").distinct()
    ask = ask.select("lead.none", "lead.doc_id", "lead.th", F.col("lead.k").alias("k"), "len", F.lit(None).cast("int").alias("start"), "lead")
    wanted = stretches.unionByName(ask).groupBy(*KEY).agg(F.collect_list(F.struct("k", "len", "start", "lead")).alias("wanted"))
    return materialize(docs.join(wanted.hint("merge"), _same(docs, wanted), "left").select(docs["none"], docs["doc_id"], docs["th"], "t", "wanted"), "found")[0]


def repeated(found: DataFrame) -> DataFrame:
    """Per document (none, doc_id, th) of ``found``: the lines to remove, as an array gone of structs a, b (first and last line), in order
    and apart. A table."""
    text = lambda ls, w: F.array_join(F.slice(ls, w["k"] + 1, w["len"]), "\n")
    cut = lambda ls: F.transform("wanted", lambda w: F.struct(w["k"].alias("k"), w["len"].alias("len"), w["start"].alias("start"), w["lead"].alias("lead"), text(ls, w).alias("text")))
    texts = found.where("wanted is not null").select(*KEY, F.explode(let(F.split("t", "\n", -1), cut)).alias("w")).select(*KEY, "w.*")
    texts, path = materialize(texts, "repeats")
    lead = texts.where("start is null").select("lead", "len", F.col("text").alias("lead_text")).dropDuplicates(["lead", "len"])
    lead, lead_path = materialize(lead, "lead")
    same = texts.where("start is not null").join(lead, ["lead", "len"]).where("text = lead_text")
    spans = same.select(*KEY, F.col("start").alias("a"), (F.col("k") + F.col("len") - 1).alias("b"))
    w = Window.partitionBy(*KEY).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = apart.groupBy(*KEY, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone, _ = materialize(merged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone")), "gone")
    discard(found.sparkSession, path, lead_path)
    return gone


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (without the repeated chunks), n_lines, n_removed (lines)."""
    found = _wanted(_keyed(docs, id_col, text_col))
    gone = repeated(found)
    some = found.where("wanted is not null")
    met = some.join(gone.hint("merge"), _same(some, gone), "left").select(some["doc_id"], "t", "gone")
    whole = F.struct(F.col("t").alias("text"), F.lit(0).cast("long").alias("n"))

    def without(ls: Column) -> Column:
        start = lambda i: F.when(i > 0, F.get("gone", i - 1)["b"] + 1).otherwise(0)
        end = lambda i: F.coalesce(F.get("gone", i)["a"], F.size(ls))
        stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(ls, start(i) + 1, end(i) - start(i))))
        lost = F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"] + 1)
        return F.struct(F.array_join(stays, "\n").alias("text"), lost.alias("n"))

    rest = found.where("wanted is null").select("doc_id", "t", whole.alias("r"))
    both = rest.union(met.select("doc_id", "t", F.when(F.col("gone").isNull(), whole).otherwise(let(F.split("t", "\n", -1), without)).alias("r")))
    return both.select("doc_id", "r.text", F.size(F.split("t", "\n", -1)).cast("long").alias("n_lines"), F.col("r.n").alias("n_removed"))


def report(docs: DataFrame, **columns) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    t = F.col("text")
    return dedup(docs, **columns).select("doc_id", "n_lines", "n_removed", F.length(t).cast("long").alias("kept_chars"), F.sha2(t, 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM l
), r AS (SELECT *, (v + {FACTOR} * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {PRIME} < {ENDS} AS ends FROM h
), e AS (
  SELECT doc_id, i, least(coalesce(min(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {MAX_LINES - 1} FOLLOWING), i + {MAX_LINES - 1}), max(i) OVER (PARTITION BY doc_id)) AS last FROM r
), chunks AS (
  SELECT doc_id, e.i, last, string_agg(line, chr(10) ORDER BY l.i) AS text FROM e JOIN l USING (doc_id) WHERE l.i BETWEEN e.i AND last AND last > e.i GROUP BY ALL
), seen AS (SELECT *, first_value(doc_id) OVER w AS lead_id, first_value(i) OVER w AS lead_i FROM chunks WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY text ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN lead_id = doc_id THEN greatest(i, lead_i + last - i + 1) ELSE i END, last + 1)) AS i FROM seen WHERE NOT (lead_id = doc_id AND lead_i = i)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
