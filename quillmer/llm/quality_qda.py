"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian over the statistics of :func:`document_statistics`. Its covariance is shrunk towards the pooled
one and then towards a multiple of the identity, and its Cholesky factor is computed once. A score is the difference of the
two Mahalanobis log-densities, put through a logistic curve fitted on the same labelled rows.

Defined results: a null text counts as empty; an empty text gets the score of the all-zero statistics; ties, repeated rows
and extra columns don't matter, since a row's score depends on its text alone; an empty table gives an empty result. Labels
that are null are left out; repeated labels of one document are averaged, 0.5 counting as 1. With no labelled rows of a
class the scores are all the share of label 1 (0.5 with no labels at all).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col, text_bytes

#: bound on the labelled rows that are used for fitting; each is 16 numbers on the driver
MAX_FIT_ROWS = 60_000
#: score from which a document counts as good
THRESHOLD = 0.3
SHRINK_POOLED = 0.15
SHRINK_IDENTITY = 0.01

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>=_~^@/\\{}[]+",
    "pipe": b"|",
    "stop": b".,;:",
    "shout": b"!?",
}
_MASKS = np.zeros((len(_CLASSES) + 1, 256))
for _k, _v in enumerate(_CLASSES.values()):
    _MASKS[_k, list(_v)] = 1
_MASKS[-1, 128:] = 1
N_STATISTICS = 16


def document_statistics(text: bytes) -> np.ndarray:
    """Sixteen transformed statistics of a whole text, given as UTF-8 bytes."""
    out = np.zeros(N_STATISTICS)
    n = len(text)
    if not n:
        return out
    upper, lower, digit, symbol, pipe, stop, shout, high = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n_words = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n_lines = max(1, len(lines))
    rate = np.array([
        upper / (upper + lower + high + 1), digit / n, symbol / n, pipe / n_words, stop / n_words, shout / n_words,
        sum(map(eq, words, words[1:])) / n_words, top / n_words, 1 - len(set(lines)) / n_lines,
        sum(len(w) == 1 for w in counts) / n_words, (n - sum(map(len, words))) / n, sum(len(w) > 14 for w in counts) / n_words,
    ])
    out[:12] = np.log(rate + 0.01)
    out[12] = np.log1p(len(words))
    out[13] = np.log1p((upper + lower + high) / n_words)
    out[14] = np.log((len(counts) + 1) / (n_words + 1))
    out[15] = np.log(n_words / n_lines)
    return out


@dataclass(frozen=True)
class QdaModel:
    """Means, inverse Cholesky factors, log-determinants and priors by class, and the logistic curve over their difference."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] + self.log_prior[k] for k in (0, 1)]
        return np.arcsinh(density[1] - density[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -35, 35)))


def fit_matrix(x: np.ndarray, y: np.ndarray) -> QdaModel:
    """Fit on a matrix of statistics and 0/1 labels; the result doesn't depend on the order of the rows."""
    n1 = int((y == 1).sum())
    if n1 < 2 or len(y) - n1 < 2:
        share = (n1 + 0.5) / (len(y) + 1)
        none = np.zeros(0)
        return QdaModel(none, none, none, none, 0.0, float(np.log(share / (1 - share))))
    d = x.shape[1]
    groups = [x[y == k] for k in (0, 1)]
    mean = np.array([g.mean(0) for g in groups])
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own)) / len(x)
    factor, log_det = [], []
    for c in own:
        c = (1 - SHRINK_POOLED) * c + SHRINK_POOLED * pooled
        c = (1 - SHRINK_IDENTITY) * c + SHRINK_IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(chol))
        log_det.append(2 * np.log(np.diag(chol)).sum())
    model = QdaModel(mean, np.array(factor), np.array(log_det), np.log([len(g) / len(x) for g in groups]), 1.0, 0.0)
    m, a, b = model.margin(x), 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-dimensional logistic regression with a small penalty on the slope
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((y - p) * m).sum() - 1e-3 * a, (y - p).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return QdaModel(mean, np.array(factor), np.array(log_det), model.log_prior, float(a), float(b))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([document_statistics(t) for t in text])


def held_out(id_col: str):
    """True for the fifth of the documents whose labels are never learnt from; null ids are held out."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> QdaModel:
    """Fit on the labelled documents that aren't held out, or on a hash sample of about ``max_fit_rows`` of them.

    Only the sample's ids and labels are broadcast and only its statistics reach the driver, so both are bounded by
    ``max_fit_rows`` whatever the tables hold.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.select(col(id_col).alias("k"), col(label_col).cast("double").alias("y"))
        .where("k is not null and y is not null").where(~(F.crc32(F.col("k").cast("string")) % 5 == 0))
    )
    n = known.count()
    every = max(1, -(-n // max_fit_rows))
    sample = known.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = (
        docs.select(col(id_col).alias("k"), text_bytes(text_col).alias("t"))
        .join(F.broadcast(sample), "k").select("y", _statistics("t").alias("x")).toPandas()
    )
    if rows.empty:
        return fit_matrix(np.zeros((0, N_STATISTICS)), np.zeros(0))
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit_matrix(x[order], y[order])


def score_column(df: DataFrame, model: QdaModel, text_col: str = "text"):
    """The score of a row's text as a column of ``df``."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([document_statistics(t) for t in text])))

    return score(text_bytes(text_col))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fit_args)
    out = docs.select(col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """The rows of ``docs``, columns untouched, whose text is classified as good."""
    model = fit(docs, labels, text_col=text_col, **fit_args)
    return docs.where(score_column(docs, model, text_col) >= threshold)
