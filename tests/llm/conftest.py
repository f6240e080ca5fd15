import pytest

#: rows with nulls, empty and repeated texts, ties, and columns whose names the operators use inside
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nOne two three.\nFour five six.", "en", "s1", 1),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.\nOne two three.\nFour five six.", "en", "s1", 1),
    (2, None, None, None, None), (3, "", "en", "s1", 0), (4, "   \n\t ", "de", "s2", 5), (None, "a b c d e f", "fr", None, 11), (None, None, None, None, None),
    (5, "same same same same same same same same same same same same", "xx", "s2", 59), (6, "word", "en", "s2", 4), (7, "Ünïcödé 中文 😀 text with a+b@c.de and 1.2.3.4", "en", "", 44),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for c in ("found", "fp", "key", "src", "size", "t", "words", "taken", "row", "_row", "score", "k", "base", "th"):
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def long_text():
    """A text of about a megabyte."""
    return " ".join(f"word{i % 5000} x{i % 7}\n" if i % 11 == 0 else f"word{i % 5000}" for i in range(130_000))
