"""Vector functions on array<double> columns: distances, normalisation, locality-sensitive keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero, so a zero vector is never near anything."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_normalise(a: Column) -> Column:
    """Divided by the norm; a zero vector stays as it is."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / F.coalesce(n, F.lit(1.0)))


def planes(bits: int, dim: int, seed: int = 1, dist: str = "normal", low: float = -1.0, high: float = 1.0) -> np.ndarray:
    """``bits`` seeded random directions, at six decimals so that other engines can repeat them."""
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((bits, dim)) if dist == "normal" else rng.uniform(low, high, (bits, dim))
    return np.round(p, 6)


def literal(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def srp_bit(a: Column, plane: np.ndarray) -> Column:
    return F.when(dot(a, literal(plane)) >= 0, 1).otherwise(0)


def srp_key(a: Column, table: np.ndarray) -> Column:
    """Sign random projection: one bit per plane (dot >= 0), first plane highest."""
    key = F.lit(0)
    for plane in table:
        key = key * 2 + srp_bit(a, plane)
    return key.cast("long")


def pstable_key(a: Column, table: np.ndarray, b: float, r: float) -> Column:
    """p-stable key: (dot + b) / r towards zero for each direction, written one after the other."""
    return F.concat(*[((dot(a, literal(p)) + F.lit(float(b))) / F.lit(float(r))).cast("int").cast("string") for p in table])
