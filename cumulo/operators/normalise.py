"""Reweighting and scaling of feature matrices: IDF, L2, min-max, z-score.

A column's statistics are one aggregation over all rows (partial sums per task, one row back per feature count), applied
to each row as literal arrays. Rows never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.vectors import ZERO, lit_vector, norm, width

NORMS = ("none", "l2", "minmax", "zscore")


def _per_feature(points: DataFrame, **aggregates: Callable[[Column], Column]) -> dict[str, list]:
    """Each aggregate of every feature, in one pass over flat columns."""
    n = width(points)
    if n == 0:
        return {k: [] for k in aggregates}
    row = points.agg(*[f(F.col("x")[i]).alias(f"{k}_{i}") for k, f in aggregates.items() for i in range(n)]).first()
    return {k: [row[f"{k}_{i}"] for i in range(n)] for k in aggregates}


def normalize_l2(points: DataFrame) -> DataFrame:
    """Each row divided by its length; rows shorter than 1e-15 pass as they are."""
    return points.withColumn("x", F.transform("x", lambda v: v / F.when(norm(F.col("x")) < ZERO, F.lit(1.0)).otherwise(norm(F.col("x")))))


def count_zero_rows(points: DataFrame) -> int:
    """The rows that normalize_l2 passes as they are."""
    return points.agg(F.count_if(norm(F.col("x")) < ZERO).alias("n")).first()["n"]


def _rescale(points: DataFrame, shift: list[float], scale: list[float]) -> DataFrame:
    """(x - shift) / scale; a feature whose scale is below 1e-15 becomes 0."""
    factors = F.arrays_zip(lit_vector(shift).alias("a"), lit_vector([s if s >= ZERO else 0.0 for s in scale]).alias("b"))
    return points.withColumn("x", F.zip_with("x", factors, lambda v, f: F.when(f["b"] == 0, F.lit(0.0)).otherwise((v - f["a"]) / F.when(f["b"] == 0, F.lit(1.0)).otherwise(f["b"]))))


def normalize_minmax(points: DataFrame) -> DataFrame:
    """Each feature to [0, 1]; a constant one becomes 0."""
    s = _per_feature(points, lo=F.min, hi=F.max)
    return _rescale(points, s["lo"], [h - lo for lo, h in zip(s["lo"], s["hi"])]) if s["lo"] else points


def normalize_zscore(points: DataFrame) -> DataFrame:
    """Each feature to mean 0 and population deviation 1; a constant one becomes 0."""
    s = _per_feature(points, mean=F.avg, sd=F.stddev_pop)
    return _rescale(points, s["mean"], s["sd"]) if s["mean"] else points


def document_frequency(points: DataFrame, threshold: float = 0.0) -> list[int]:
    """For each feature the rows where it is above the threshold."""
    return _per_feature(points, df=lambda c: F.count_if(c > F.lit(float(threshold))))["df"]


def weight_idf(points: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Each feature times ln(N / (1 + df)): negative where df = N, 0 where df = N - 1."""
    n = points.count()
    df = document_frequency(points, threshold)
    if not df:
        return points
    return points.withColumn("x", F.zip_with("x", lit_vector([math.log(n / (1.0 + d)) for d in df]), lambda v, w: v * w))


def idf_imbalance(points: DataFrame, threshold: float = 0.0) -> tuple[int, int]:
    """(rare, common): features in fewer than 5 % and in more than 80 % of the rows."""
    n = points.count()
    df = document_frequency(points, threshold)
    return sum(d / n < 0.05 for d in df), sum(d / n > 0.80 for d in df)


def normalize(points: DataFrame, how: str = "l2") -> DataFrame:
    steps = {"none": lambda p: p, "l2": normalize_l2, "minmax": normalize_minmax, "zscore": normalize_zscore}
    if how not in steps:
        raise ValueError(f"unknown norm {how!r}; known: {', '.join(NORMS)}")
    return steps[how](points)


def prepare(points: DataFrame, how: str = "l2", idf: bool = True) -> DataFrame:
    """IDF first, then the norm."""
    return normalize(weight_idf(points) if idf else points, how)
