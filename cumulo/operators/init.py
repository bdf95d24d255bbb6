"""Starts of the clustering: initial memberships from a hash, from K-Means++ seeds or from given labels.

A start matters only through the memberships it gives; the first centroids are computed from those.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.vectors import lit_vector, squared_distance

DOMAIN_OWN, SEED_OWN = 0.8, 0.7
_A, _B, _MOD = 2654435761, 40503, 1 << 32
#: Ranges of row ids whose sums the driver gets at once when sampling.
RANGES = 1024


@dataclass(frozen=True)
class Start:
    """kind: random, seeds or labels. seeds: K-Means++ points. label: the column of given labels."""

    kind: str
    clusters: int
    seed: int = 42
    seeds: tuple[tuple[float, ...], ...] = ()
    label: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("random", "seeds", "labels"):
            raise ValueError(f"unknown start {self.kind!r}")
        if self.clusters < 1:
            raise ValueError("at least one cluster is needed")

    def apply(self, points: DataFrame) -> DataFrame:
        """points with u0, the initial memberships."""
        if self.kind == "random" or (self.kind == "labels" and self.label is None):
            return points.withColumn("u0", random_membership(self.clusters, self.seed))
        if self.kind == "seeds":
            return points.withColumn("u0", seed_membership(F.col("x"), self.seeds))
        return points.withColumn("u0", domain_membership(F.col(self.label), self.clusters))


def random_membership(clusters: int, seed: int = 42, row_id: str = "row_id") -> Column:
    """A hash of row, cluster and seed, plus 1e-9, normalised: the same whatever the partitions."""
    raw = [F.pmod(F.pmod(F.col(row_id), F.lit(_MOD)) * F.lit(_A % 65537) + F.lit((j * _B + seed) * 7919), F.lit(65521)) for j in range(clusters)]
    again = [F.pmod(r * r + F.lit(j * 31 + 7) * r + F.lit(seed), F.lit(65521)) / F.lit(65521.0) + F.lit(1e-9) for j, r in enumerate(raw)]
    rows = F.array(*again)
    return F.transform(rows, lambda v: v / F.aggregate(rows, F.lit(0.0), lambda s, w: s + w))


def _dominant(own: float, dominant: Column, clusters: int) -> Column:
    """own for one cluster and the rest shared by the others; a single cluster has all."""
    if clusters == 1:
        return F.array(F.lit(1.0))
    rest = (1.0 - own) / (clusters - 1)
    sum_ = own + rest * (clusters - 1)
    return F.array(*[F.when(dominant == j, F.lit(own / sum_)).otherwise(F.lit(rest / sum_)) for j in range(clusters)])


def in_range(label: Column, clusters: int) -> Column:
    return F.coalesce((label >= 0) & (label < clusters), F.lit(False))


def domain_membership(label: Column, clusters: int) -> Column:
    """0.8 for the given label; a label out of range (or null) counts as cluster 0 here."""
    return _dominant(DOMAIN_OWN, F.when(in_range(label, clusters), label).otherwise(F.lit(0)), clusters)


def class_means(points: DataFrame, label: str, clusters: int) -> DataFrame:
    """(j, f, v): the mean of each class; labels out of range are left out, a class without members is missing."""
    long = points.where(in_range(F.col(label), clusters)).select(F.col(label).cast("int").alias("j"), F.posexplode("x").alias("f", "v"))
    return long.groupBy("j", "f").agg(F.avg("v").alias("v"))


def class_seeds(points: DataFrame, label: str, clusters: int, seed: int = 42) -> list[list[float]]:
    """The class means, with a point picked by a hash for a class without members."""
    found: dict[int, dict[int, float]] = {}
    for r in class_means(points, label, clusters).collect():
        found.setdefault(r["j"], {})[r["f"]] = r["v"]
    missing = [j for j in range(clusters) if j not in found]
    spare = [list(r["x"]) for r in points.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(len(missing)).collect()] if missing else []
    return [[found[j][f] for f in sorted(found[j])] if j in found else spare[missing.index(j) % len(spare)] for j in range(clusters)]


def index_label(clusters: int, row_id: str = "row_id") -> Column:
    """The default label, row_id modulo the number of clusters."""
    return F.pmod(F.col(row_id), F.lit(clusters)).cast("int")


# --- K-Means++ ------------------------------------------------------------------------------------------------------


def sample_by_weight(weighted: DataFrame, r: float, weight: str = "d2") -> int | None:
    """The first row_id whose running sum of weights, in row_id order, reaches r times the total; the last row if none does.

    The ids' span is cut into RANGES ranges, whose sums tell the one where the bound is reached; that one is cut again, until it is a single
    id. Each round is an aggregation with at most RANGES groups, whatever the ids are like; nothing is sorted. A round more is needed for
    every factor of RANGES in the span.
    """
    first = weighted.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.sum(weight).alias("total")).first()
    if first["lo"] is None:
        return None
    low, high, goal, below = first["lo"], first["hi"], r * (first["total"] or 0.0), 0.0
    while low < high:
        size = (high - low) // RANGES + 1
        k = F.floor((F.col("row_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(size).cast("decimal(20,0)")).cast("int")
        sums = weighted.where(F.col("row_id").between(low, high)).groupBy(k.alias("k")).agg(F.sum(weight).alias("w"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).collect()
        for s in sorted(sums, key=lambda s: s["k"]):
            if below + s["w"] >= goal:
                low, high = s["lo"], s["hi"]
                break
            below += s["w"]
        else:
            return first["hi"]
    return low


def nearest_square(x: Column, seeds: tuple[tuple[float, ...], ...] | list) -> Column:
    """The squared distance to the nearest seed."""
    squares = [squared_distance(x, lit_vector(list(s))) for s in seeds]
    return squares[0] if len(squares) == 1 else F.least(*squares)


def draw(seed: int, k: int) -> float:
    """A number in [0, 1) from the seed, for the k-th choice."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:6], "big") / float(1 << 48)


def kmeanspp_picks(points: DataFrame, clusters: int, seed: int = 42, first: int | None = None) -> list[tuple[int, tuple[float, ...]]]:
    """(row_id, coordinates) of the seeds: the first by a draw over the ids' order (or the given row_id), each further one by squared distance from the chosen."""
    if first is None:
        first = sample_by_weight(points.select("row_id", F.lit(1.0).alias("d2")), draw(seed, 0))
    chosen: list[tuple[int, tuple[float, ...]]] = []
    pick = first
    for k in range(clusters):
        if k:
            pick = sample_by_weight(points.select("row_id", nearest_square(F.col("x"), [x for _, x in chosen]).alias("d2")), draw(seed, k))
        row = points.where(F.col("row_id") == F.lit(pick)).select("x").first()
        if row is None:
            raise ValueError("there are no points to choose from")
        chosen.append((pick, tuple(row["x"])))
    return chosen


def kmeanspp_seeds(points: DataFrame, clusters: int, seed: int = 42, first: int | None = None) -> tuple[tuple[float, ...], ...]:
    return tuple(x for _, x in kmeanspp_picks(points, clusters, seed, first))


def seed_membership(x: Column, seeds: tuple[tuple[float, ...], ...]) -> Column:
    """0.7 for the nearest seed (of equal ones the first), 0.3 shared by the others."""
    squares = F.array(*[squared_distance(x, lit_vector(list(s))) for s in seeds])
    return _dominant(SEED_OWN, F.array_position(squares, F.array_min(squares)) - 1, len(seeds))


def start(points: DataFrame, strategy: str, clusters: int, seed: int = 42, label: str | None = None) -> Start:
    """The start of a strategy: random, kmeanspp or domain (random without labels)."""
    if strategy == "random":
        return Start("random", clusters, seed)
    if strategy == "kmeanspp":
        return Start("seeds", clusters, seed, kmeanspp_seeds(points, clusters, seed))
    if strategy == "domain":
        return Start("labels", clusters, seed, label=label)
    raise ValueError(f"unknown strategy {strategy!r}")
