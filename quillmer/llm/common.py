"""Helpers shared by the corpus operators: bounded Arrow batches, safe column handling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh_path, materialize  # noqa: F401

#: rows and bytes of one Arrow batch; long texts make row counts alone a poor memory bound
BATCH_ROWS = 512
BATCH_BYTES = 8 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch limits of the session so that a batch of very long texts fits in a worker. They
    are read when a query runs, not when it is built, so they stay lowered; results don't depend on them."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = conf.get(key, None)
    if limit is not None and not limit.isdigit() or limit is not None and int(limit) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def fresh_name(df: DataFrame, want: str) -> str:
    """A column name that ``df`` doesn't use, compared as Spark resolves names (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def col(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: elements of a block of ``running``
_BLOCK = 64


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, ``op`` over all elements before it, from ``zero`` on; ``op`` must be associative.

    An array that grows by one element a step costs the square of its length. Here only blocks grow so: the values of blocks
    and of blocks of blocks come first, so the work is linear in the array.
    """
    part = lambda xs, j: F.slice(xs, j * _BLOCK + 1, F.lit(_BLOCK))
    total = lambda xs: F.aggregate(xs, zero, op)
    totals = lambda xs: F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda j: total(part(xs, j)))).otherwise(F.slice(xs, 1, 0))

    def steps(xs: Column, start: Column) -> Column:
        none = F.slice(F.array(start), 1, 0)
        return F.aggregate(xs, F.struct(start.alias("now"), none.alias("out")), lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))["out"]

    down = lambda starts, xs: F.flatten(F.transform(starts, lambda v, j: steps(part(xs, j), v)))
    return let(values, lambda a: let(totals(a), lambda b: let(totals(b), lambda c: down(down(steps(c, zero), b), a))))


def text_bytes(text_col: str) -> Column:
    """The whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(col(text_col), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
