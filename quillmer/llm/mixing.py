"""Mixing sources to target weights.

Each document gets a hash-random key. A source's rows are range-sorted by that key and cut where the prefix sum of their
sizes reaches the source's exact budget; whole epochs come before the cut. The sort and the prefix sum are distributed in
two levels: the key range of a source with n rows is cut into about sqrt(n) equal ranges, whose sums are small enough for
one window, and only the range that holds the cut is sorted row by row. What a row gives then follows from its own key and
its source's cut, so the documents themselves are never shuffled.

Sources sorted by code point, null last, weigh 5, 2, 1, repeating. Targets are shares of all words, at most ``max_epochs``
times the source's words; what is above goes to the others by weight until none is above.

Defined results: a null text has size 0; a document of size 0 gives 0; a null source is a source of its own; rows that are
equal in id and text are ordered as one and share alike at the cut; an empty table gives an empty result; with no words at
all every target is 0; extra columns are ignored (or kept, by ``mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, fresh_name, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: sources up to which their cuts (one row each, about 100 bytes) are broadcast; beyond, joins shuffle
MAX_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (src, size and further columns, a row per source) with weight and target: weight shares of all words, none above
    ``max_epochs`` times its size.

    Sources reach their limits in the order of size / weight; those that do leave the rest to the others. Running sums over
    that order give, for each source, the level if all before it are at their limits; the first one that stays below its own
    limit then sets the level. These windows stream over one row per source; nothing is gathered.
    """
    ranked = F.row_number().over(Window.orderBy(F.col("src") == "n", "src"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (ranked - 1) % len(weights))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("size") / F.col("weight"))
    upto = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(every) - max_epochs * F.coalesce(F.sum("size").over(upto), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    leveled = weighed.withColumn("own", left.cast("double") / share.cast("double"))
    below = F.col("own") * F.col("weight") <= max_epochs * F.col("size")
    at = leveled.where(below).agg(F.min(F.struct("ratio", "src", "own")).alias("at"))
    target = F.when(F.col("ratio") >= F.col("at.ratio"), F.col("at.own") * F.col("weight")).otherwise((max_epochs * F.col("size")).cast("double"))
    return weighed.join(F.broadcast(at)).withColumn("target", target).drop("ratio", "at")  # one row


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def key_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Hash-random key: 32 hex digits that follow from id and text."""
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(col(text_col), F.lit("")))))


def _source_key(source_col: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit("n"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_SOURCES else df


def _range(n: Column) -> Column:
    """The row's range among ``n`` equal ranges of keys."""
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(float(1 << 32))).cast("long")


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Per source of ``rows`` (src, size, key): source_size, target, epochs, cut_key, cut_each; and the number of sources.

    A row gives ``epochs`` times its size, once more its size if its key is below cut_key, and cut_each at cut_key.
    """
    total = targets(rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5)
    planned = total.select("src", F.col("size").alias("source_size"), "target", F.expr("CASE WHEN size > 0 THEN CAST(floor(target + 0.5D) AS BIGINT) div size ELSE 0L END").alias("epochs"), budget.cast("long").alias("budget"), F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("long").alias("ranges"))
    planned, planned_path = materialize(planned.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("budget"), "targets")
    n = planned.count()
    joined = rows.join(_small(planned.where("rest > 0").select("src", "rest", "ranges"), n), "src").withColumn("rng", _range(F.col("ranges")))
    before = F.sum("size").over(Window.partitionBy("src").orderBy("rng")) - F.col("size")
    ranges = joined.groupBy("src", "rng").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).withColumn("base", before)
    ranges = ranges.where("base < rest and rest <= base + size").select("src", "rng", "base")
    base, base_path = materialize(ranges, "ranges")
    within = joined.join(_small(base, n), ["src", "rng"]).groupBy("src", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("src").orderBy("key"))
    at = within.withColumn("upto", upto).where("upto - size < rest and rest <= upto").select("src", F.col("key").alias("cut_key"), F.expr("(rest - (upto - size)) div n").alias("cut_each"))
    found, _ = materialize(planned.join(at, "src", "left").drop("rest", "ranges"), "cuts")
    discard(rows.sparkSession, planned_path, base_path)
    return found, n


def taken() -> Column:
    return F.col("epochs") * F.col("size") + F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_each")).otherwise(0)


def shares(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **args) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows, _ = materialize(docs.select(col(id_col).alias("doc_id"), _source_key(source_col).alias("src"), size_of(text_col).alias("size"), key_of(id_col, text_col).alias("key")), "sizes")
    found, n = cuts(rows, **args)
    return rows.join(_small(found, n), "src").select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **args) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns untouched but for the text of a source's last
    row, which ends at the budget."""
    rows, _ = materialize(docs.select(_source_key(source_col).alias("src"), size_of(text_col).alias("size"), key_of(id_col, text_col).alias("key")), "sizes")
    found, n = cuts(rows, **args)
    row = fresh_name(docs, "row")
    wide = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), _source_key(source_col).alias("src"), size_of(text_col).alias("size"), key_of(id_col, text_col).alias("key"))
    wide = wide.join(_small(found, n), "src").withColumn("taken", taken()).where("taken > 0")
    copies = F.expr("sequence(1L, (taken + size - 1) div size)")
    text = col(row)[text_col]
    words = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    cut = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?s)^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){"), (words - 1).cast("string"), F.lit(r"}+[^\x20\x09-\x0D]++")), F.lit(0))
    whole = F.col("copy") * F.col("size") <= F.col("taken")
    out = wide.withColumn("copy", F.explode(copies))
    return out.select(*[F.when(whole, text).otherwise(cut).alias(c) if c == text_col else col(row)[c].alias(c) for c in docs.columns])


#: the same results with one window per source
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s
), lv AS (SELECT min_by(CAST(rest AS DOUBLE) / CAST(share AS DOUBLE), size / w) AS level, min(size / w) AS ratio FROM o WHERE CAST(rest AS DOUBLE) / CAST(share AS DOUBLE) * w <= 3 * size
), t AS (
  SELECT source, size AS source_size, CASE WHEN size / w >= ratio THEN level * w ELSE CAST(3 * size AS DOUBLE) END AS target FROM s, lv
), b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY key) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""
