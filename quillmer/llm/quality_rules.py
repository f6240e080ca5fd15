"""Quality rules: base counts, and a verdict on distribution divergence. DataFrame functions only.

Each document's character classes and common words are counted in one pass, and each histogram is compared with the fixed
reference of its language. The Jensen-Shannon distances of the two histograms are divided by their scales and added; a
document is rejected if the sum is above the limit for its length. Short texts vary more, so they have higher limits, and
those under the minimum length aren't judged. The references don't come from the table under judgement, so the verdict on a
row doesn't depend on any other.

Defined results: a null text has no words; base counts of an empty text are 0 and it fails the base rules; a language without
a reference has no verdict and the base rules alone decide (a region as in "en-GB" doesn't matter); a null or empty language
is taken for the listed one of whose common words the text has most, if they are at least a tenth of its words, else it has
no reference; repeated rows each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, let

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
#: most words, in percent, in repeated windows
MAX_REPEAT = 20
#: characters from which a document is judged
MIN_CHARS = 200
#: scales of the Jensen-Shannon distances (square roots of divergences in bits) of character classes and common words
CHAR_SCALE = 0.35
WORD_SCALE = 0.45
#: words from which each limit of the sum of scaled distances holds; documents of fewer words aren't judged
LIMITS = ((40, 1.3), (100, 1.05), (150, 0.9))
#: share of listed words from which a text without a language is taken for theirs
MIN_KNOWN = 0.1

# Frequent function words of each language, most frequent first.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}
#: counted classes, in order; white space and all other characters (lower-case and other letters) follow
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()/-]", r"[\[\]{}=_@~^\\+`]", SYMBOLS)
# Shares of these classes and of white space in printed prose, rounded; the same for all listed languages.
CLASS_SHARES = (0.025, 0.005, 0.028, 0.0005, 0.0005, 0.16)
#: share of the word of rank r among the common ones: FIRST / r ** FALL, after Zipf
FIRST, FALL = 0.062, 0.87


def char_reference() -> list[float]:
    return [*CLASS_SHARES, 1 - sum(CLASS_SHARES)]


def word_reference(n: int = 20) -> list[float]:
    shares = [round(FIRST / r**FALL, 6) for r in range(1, n + 1)]
    return [*shares, 1 - sum(shares)]


def window_hashes(words: Column) -> Column:
    """Hashes of the windows of five words, in order."""
    ahead = [words, *[F.slice(words, F.lit(k + 1), F.size(words)) for k in range(1, WINDOW)]]
    return F.slice(F.transform(F.arrays_zip(*ahead), lambda w: F.xxhash64(w)), F.lit(1), F.greatest(F.lit(0), F.size(words) - WINDOW + 1))


def n_repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows of five that occur twice or more in ``words``, given the windows' hashes (both columns).

    Hashes that are all distinct prove that no window repeats; otherwise the windows of equal hashes are sorted and compared.
    """
    def beside(xs: Column, f: str) -> Column:
        """Those of the sorted structs that have a neighbour with the same ``f``."""
        same = lambda x, k: (k >= 0) & (F.get(xs, k)[f] == x[f])
        return F.filter(xs, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))

    window = lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ")
    alike = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda xs: beside(xs, "h"))
    equal = let(F.sort_array(F.transform(alike, lambda x: F.struct(window(x["i"]).alias("w"), x["i"].alias("i")))), lambda xs: beside(xs, "w"))
    places = F.sort_array(F.transform(equal, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def _without(text: Column, pattern: str) -> Column:
    """Number of characters of a class that is rare in ``text``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def count(lines: Column) -> Column:
        filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.when(F.size(F.array_distinct(lines)) == F.size(lines), 0).otherwise(let(filled, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))))

    return let(F.split(text, "\n"), count).cast("long")


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang (null if it has no reference), n_words, n_chars, the base counts, chars and common (histograms)."""
    t, words = F.col("t"), F.col("words")
    lang = F.substring_index(F.substring_index(F.lower(F.trim(col(lang_col).cast("string"))), "-", 1), "_", 1)
    first = docs.select(col(id_col).alias("doc_id"), F.when(lang != "", lang).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    split = first.select("doc_id", "lang", "t", F.array_remove(F.split(t, SPACE + "+"), "").alias("words"))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    known = F.filter(F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))), lambda w: w.isin(listed))
    # all classes that are counted are among the characters that are neither a to z nor spaces
    counted = split.select(
        "doc_id", "lang", "words", F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.length(t).cast("long").alias("n_chars"),
        n_dup_lines(t).alias("n_dup_lines"), window_hashes(words).alias("hashes"), F.regexp_replace(t, r"[a-z\x20]++", "").alias("rest"), known.alias("known"),
    )
    # expressions for each word or language are kept small: generated code that is too large isn't compiled
    n, names = F.col("n_words"), sorted(COMMON_WORDS)
    lists = F.array(*[F.struct(F.lit(x).alias("x"), F.array(*map(F.lit, COMMON_WORDS[x])).alias("ws")) for x in names])
    by_lang = F.transform(lists, lambda g: F.struct(F.size(F.filter("known", lambda w: F.array_contains(g["ws"], w))).alias("n"), g["x"].alias("x")))
    best = lambda gs: F.filter(gs, lambda g: g["n"] == F.aggregate(gs, F.lit(0), lambda a, o: F.greatest(a, o["n"])))[0]
    guess = let(let(by_lang, best), lambda g: F.when(g["n"] >= MIN_KNOWN * n, g["x"]))
    named = counted.withColumn("lang", F.when(F.col("lang").isin(names), F.col("lang")).when(F.col("lang").isNull() & (n > 0), guess)).select(
        "doc_id", "lang", "n_words", "n_chars", "word_chars", "n_dup_lines", n_repeat_words(words, F.col("hashes")).alias("n_repeat_words"),
        F.concat(F.lit(" "), F.array_join("known", "  "), F.lit(" ")).alias("known"), *[_without(F.col("rest"), p).alias(f"c{i}") for i, p in enumerate(CLASSES)],
    )
    # each listed word has a space of its own on both sides, so that its occurrences can be cut out and measured
    mine = F.coalesce(*[F.when(F.col("lang") == x, F.array(*[F.lit(f" {w} ") for w in ws])) for x, ws in COMMON_WORDS.items()])
    number = lambda w: (F.length("known") - F.length(F.replace(F.col("known"), w, F.lit("")))) / F.length(w)
    common = F.when(F.col("lang").isNotNull(), let(F.transform(mine, number), lambda b: F.concat(b, F.array(n - F.aggregate(b, F.lit(0.0), lambda s, x: s + x)))))
    own = [F.col(f"c{i}") for i in range(len(CLASSES))]
    chars = F.array(*[c.cast("double") for c in (*own, F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - sum(own))])
    return named.select("doc_id", "lang", "n_words", "n_chars", "word_chars", F.col(f"c{len(CLASSES) - 1}").alias("n_symbols"), "n_dup_lines", "n_repeat_words", chars.alias("chars"), common.alias("common"))


def _shares(h: Column) -> Column:
    total = F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    return let(total, lambda n: F.transform(h, lambda x: x / F.greatest(n, F.lit(1.0))))


def distance(h: Column, ref: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram to a distribution."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = let(_shares(h), lambda p: F.zip_with(p, ref, lambda a, b: let((a + b) / 2, lambda m: term(a, m) + term(b, m))))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame, *, limits: tuple[tuple[int, float], ...] = LIMITS, **columns) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base counts, base_failed, kept, divergence (null where not judged)."""
    counted = counts(docs, **columns)
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * n)
    fixed = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    scaled = distance(F.col("chars"), fixed(char_reference())) / CHAR_SCALE + distance(F.col("common"), fixed(word_reference())) / WORD_SCALE
    limit = F.coalesce(*[F.when(n >= least, F.lit(most)) for least, most in sorted(limits, reverse=True)])
    judged = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.when((F.col("n_chars") >= MIN_CHARS) & limit.isNotNull() & F.col("lang").isNotNull(), scaled).alias("divergence"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("divergence") > limit, F.lit(False)))


def _sql_list(xs: list) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in xs) + "]"


def _sql_occurrences(ws: list[str]) -> str:
    return f"list_transform({_sql_list(ws)}, lambda x: CAST(len(list_filter(bare, lambda y: y = x)) AS DOUBLE))"


def _sql_class(pattern: str) -> str:
    return "CAST(length(t) - length(regexp_replace(t, '" + pattern.replace("'", "''") + "', '', 'g')) AS DOUBLE)"


def _sql_distance(h: str, ref: str) -> str:
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({h}, lambda x: x / greatest(list_sum({h}), 1)), {ref}), lambda z: {term('z[1]')} + {term('z[2]')})) / 2))"


#: the same results by list functions; windows as rows
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, split_part(split_part(lower(trim(lang)), '-', 1), '_', 1) AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1
), nrep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id
), b AS (SELECT d.*, list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: list_contains({_sql_list(sorted({w for ws in COMMON_WORDS.values() for w in ws}))}, x)) AS bare FROM d
), g AS (
  SELECT b.*, {", ".join(f"list_sum({_sql_occurrences(ws)}) AS n_{x}" for x, ws in sorted(COMMON_WORDS.items()))} FROM b
), l AS (
  SELECT * EXCLUDE (lang), CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang WHEN coalesce(lang, '') = '' AND len(w) > 0 AND greatest({", ".join(f"n_{x}" for x in sorted(COMMON_WORDS))}) >= {MIN_KNOWN} * len(w) THEN
    CASE {" ".join(f"WHEN n_{x} = greatest({', '.join(f'n_{y}' for y in sorted(COMMON_WORDS))}) THEN '{x}'" for x in sorted(COMMON_WORDS))} END END AS lang FROM g
), h AS (
  SELECT *, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, [{", ".join(map(_sql_class, CLASSES))}] AS c, CASE lang {" ".join(f"WHEN '{x}' THEN {_sql_occurrences(ws)}" for x, ws in COMMON_WORDS.items())} END AS o FROM l
), s AS (
  SELECT *, list_concat(c, [CAST(length(t) - word_chars AS DOUBLE), word_chars - list_sum(c)]) AS chars, list_concat(o, [len(w) - list_sum(o)]) AS common FROM h
), j AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, word_chars, CAST(c[{len(CLASSES)}] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN length(t) >= {MIN_CHARS} AND lang IS NOT NULL THEN {_sql_distance("chars", _sql_list(char_reference()))} / {CHAR_SCALE} + {_sql_distance("common", _sql_list(word_reference()))} / {WORD_SCALE} END AS divergence
  FROM s LEFT JOIN nrep ON s.doc_id = nrep.doc_id
), r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(divergence > CASE {" ".join(f"WHEN n_words >= {least} THEN {most}" for least, most in sorted(LIMITS, reverse=True))} END, false) AS kept FROM r
"""
