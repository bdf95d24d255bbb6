"""Expressions over feature vectors, as arrays of doubles or as flat columns x0 .. x{F-1}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 1e-15


def lit_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, q: s + q)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, as the root of summed squared differences: exact near zero, where guards look."""
    return F.sqrt(squared_distance(a, b))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def width(points: DataFrame) -> int:
    """The number of features, from the first row; 0 without rows."""
    first = points.select(F.size("x").alias("n")).first()
    return first["n"] if first else 0


def flat(points: DataFrame, features: int) -> DataFrame:
    """x as flat columns, which stay inside whole-stage code generation."""
    return points.select("row_id", *[F.col("x")[i].alias(f"x{i}") for i in range(features)], *[c for c in points.columns if c not in ("row_id", "x")])


def points_from(df: DataFrame, row_id: str, features: list[Column | str], *others: str) -> DataFrame:
    """points(row_id, x, ...) from columns of a table."""
    cols = [F.col(f) if isinstance(f, str) else f for f in features]
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.array(*[c.cast("double") for c in cols]).alias("x"), *others)


def clean_zero(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
