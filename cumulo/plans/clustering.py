"""A clustering run: diagnostics of the raw features, then each strategy on the prepared ones, compared."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from cumulo.operators import fcm, metrics
from cumulo.operators.init import index_label, start
from cumulo.operators.normalise import NORMS, prepare
from cumulo.operators.profile import imbalance
from cumulo.sources.files import load_points, write_centroids, write_membership

STRATEGIES = ("random", "kmeanspp", "domain")


@dataclass(frozen=True)
class RunSettings:
    n: int = 400
    features: int = 50
    clusters: int = 4
    norm: str = "l2"
    idf: bool = True
    source: str = "synthetic"
    path: str | None = None
    seed: int = 42
    max_iterations: int = fcm.MAX_ITERATIONS
    mode: str = "strict"

    def __post_init__(self) -> None:
        if min(self.n, self.features, self.clusters) <= 0:
            raise ValueError("n, features and clusters must be positive")
        if self.norm not in NORMS:
            raise ValueError(f"unknown norm {self.norm!r}; known: {', '.join(NORMS)}")


def run_strategy(points: DataFrame, strategy: str, clusters: int, seed: int = 42, max_iterations: int = fcm.MAX_ITERATIONS) -> tuple[fcm.FcmResult, DataFrame]:
    """(result, its row of the comparison). points(row_id, x) are prepared; the default labels are row_id modulo clusters."""
    own = points.select("row_id", "x", index_label(clusters).alias("domain_label"))
    result = fcm.fit(own, start(own, strategy, clusters, seed, "domain_label"), max_iterations=max_iterations)
    return result, metrics.scores(own, result, strategy)


def compare(points: DataFrame, clusters: int, strategies: tuple[str, ...] = STRATEGIES, seed: int = 42, max_iterations: int = fcm.MAX_ITERATIONS) -> DataFrame:
    """One row per strategy: iterations, last change, Silhouette, Davies-Bouldin. The points are cached once for all."""
    cached = points.select("row_id", "x").persist()
    try:
        return reduce(DataFrame.unionByName, [run_strategy(cached, s, clusters, seed, max_iterations)[1] for s in strategies])
    finally:
        cached.unpersist()


def run(spark: SparkSession, settings: RunSettings = RunSettings(), out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(imbalance of the raw features, comparison of the strategies); with out, memberships and centroids are written there."""
    raw = load_points(spark, settings.source, settings.path, settings.n, settings.features, settings.clusters, settings.seed, settings.mode).persist()
    try:
        report = spark.createDataFrame(imbalance(raw).collect(), imbalance(raw).schema)
        points = prepare(raw, settings.norm, settings.idf).persist()
        rows = []
        for s in STRATEGIES:
            result, row = run_strategy(points, s, settings.clusters, settings.seed, settings.max_iterations)
            rows.append(row)
            if out:
                write_membership(fcm.result_membership(points.select("row_id", "x", index_label(settings.clusters).alias("domain_label")), result), f"{out}/membership_{s}.csv")
                write_centroids(spark, result.centroids, f"{out}/centroids_{s}.csv")
        points.unpersist()
        return report, reduce(DataFrame.unionByName, rows)
    finally:
        raw.unpersist()
