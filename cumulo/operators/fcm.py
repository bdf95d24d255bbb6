"""Fuzzy C-Means as an iterative DataFrame computation.

The centroids (C x F numbers) are the only state, on the driver. Memberships follow from centroids, so one iteration is one
aggregation over the cached points: it computes the memberships under the last and the last but one centroids, and
returns the weighted sums and the change of the memberships. Nothing is written per iteration and no lineage grows.

Two physical forms: numpy on Arrow batches (the default), or flat columns inside whole-stage code generation. Both send
C x F + C + 1 numbers per task to the final aggregation, and a pass over the same rows takes about as long in either; but
the flat form has the centroids as literals, so its code is compiled anew in each iteration (about a second).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.vectors import flat, total, width
from cumulo.operators.init import Start

FUZZINESS, EPSILON, MAX_ITERATIONS = 2.0, 1e-5, 150
MIN_DISTANCE, MIN_WEIGHT = 1e-10, 1e-10
#: Tasks whose partial results the driver adds up itself.
FEW_TASKS = 256
#: Above so many products C x F memberships are computed in numpy even where they are computed once, as generated code gets too long.
FLAT_LIMIT = 64

Centroids = list[list[float]]


@dataclass(frozen=True)
class FcmResult:
    """centroids are one step newer than the memberships; membership_centroids are those the memberships belong to (None: the start's)."""

    centroids: Centroids
    membership_centroids: Centroids | None
    iterations: int
    final_delta: float
    start: Start
    fuzziness: float
    history: list[tuple[int, float]] = field(default_factory=list)

    @property
    def converged(self) -> bool:
        return self.final_delta < EPSILON


# --- memberships as expressions ----------------------------------------------------------------------------------


def _memberships(squares: list[Column], m: float) -> list[Column]:
    """u_j from squared distances: 1 / sum_k (d_j / d_k)^(2 / (m - 1)); a distance below 1e-10 takes all, the last such one."""
    c = len(squares)
    hit = F.lit(-1)
    for j, s in enumerate(squares):
        hit = F.when(s < F.lit(MIN_DISTANCE**2), F.lit(j)).otherwise(hit)
    safe = [F.when(s < F.lit(MIN_DISTANCE**2), F.lit(1.0)).otherwise(s) for s in squares]
    power = 1.0 / (m - 1.0)
    ratio = (lambda a, b: a / b) if m == 2.0 else (lambda a, b: F.pow(a / b, F.lit(power)))
    return [F.when(hit >= 0, F.when(hit == j, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) / total([ratio(safe[j], safe[k]) for k in range(c)])) for j in range(c)]


def _flat_squares(points: DataFrame, centroids: Centroids, name: str) -> tuple[DataFrame, list[Column]]:
    names = [f"{name}{j}" for j in range(len(centroids))]
    squares = [total([(F.col(f"x{f}") - F.lit(float(v))) * (F.col(f"x{f}") - F.lit(float(v))) for f, v in enumerate(row)]).alias(n) for row, n in zip(centroids, names)]
    return points.select("*", *squares), [F.col(n) for n in names]


def membership(points: DataFrame, centroids: Centroids, m: float = FUZZINESS) -> DataFrame:
    """(row_id, u): the memberships of points(row_id, x) under the centroids."""
    n = len(centroids[0])
    if n * len(centroids) <= FLAT_LIMIT:
        wide, squares = _flat_squares(flat(points.select("row_id", "x"), n), centroids, "s")
        return wide.select("row_id", F.array(*_memberships(squares, m)).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.asarray(centroids, float)
        for b in batches:
            u = _numpy_membership(_matrix(b, "x", n), c, m)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), _arrays(u)], names=["row_id", "u"])

    return points.select("row_id", "x").mapInArrow(run, "row_id bigint, u array<double>")


def _matrix(batch: pa.RecordBatch, name: str, columns: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def _arrays(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))


def _numpy_membership(x: np.ndarray, c: np.ndarray, m: float) -> np.ndarray:
    """Squared differences are formed directly, a feature at a time: no cancellation near the zero guard."""
    s = np.zeros((len(x), len(c)))
    for f in range(x.shape[1]):
        d = x[:, f, None] - c[None, :, f]
        s += d * d
    near = s < MIN_DISTANCE**2
    safe = np.where(near, 1.0, s)
    power = 1.0 / (m - 1.0)
    u = 1.0 / ((safe[:, :, None] / safe[:, None, :]) ** power).sum(axis=2)
    rows = np.flatnonzero(near.any(axis=1))
    if len(rows):
        last = near.shape[1] - 1 - near[rows, ::-1].argmax(axis=1)
        u[rows] = 0.0
        u[rows, last] = 1.0
    return u


# --- one iteration ------------------------------------------------------------------------------------------------


def _centroids(weights: list[float], sums: list[list[float]]) -> Centroids:
    return [[v / max(w, MIN_WEIGHT) for v in row] for w, row in zip(weights, sums)]


def _flat_step(wide: DataFrame, new: Centroids | None, old: Centroids | None, c: int, n: int, m: float, tasks: int) -> tuple[Centroids, float]:
    """Sums of u^m x, of u^m and of the squared change, over flat points that carry the start's memberships as u0_j."""
    start = [F.col(f"u0_{j}") for j in range(c)]
    df, now, before = wide, start, start
    if new is not None:
        df, squares = _flat_squares(df, new, "sn")
        now = _memberships(squares, m)
        if old is not None:
            df, squares = _flat_squares(df, old, "so")
            before = _memberships(squares, m)
    named = df.select(*[F.col(f"x{f}") for f in range(n)], *[u.alias(f"un{j}") for j, u in enumerate(now)], *[u.alias(f"ub{j}") for j, u in enumerate(before)])
    weight = (lambda u: u * u) if m == 2.0 else (lambda u: F.pow(u, F.lit(m)))
    weighted = named.select("*", *[weight(F.col(f"un{j}")).alias(f"w{j}") for j in range(c)])
    row = weighted.agg(
        *[F.sum(f"w{j}").alias(f"w{j}") for j in range(c)],
        *[F.sum(F.col(f"w{j}") * F.col(f"x{f}")).alias(f"s{j}_{f}") for j in range(c) for f in range(n)],
        F.sum(total([(F.col(f"un{j}") - F.col(f"ub{j}")) * (F.col(f"un{j}") - F.col(f"ub{j}")) for j in range(c)])).alias("q"),
    ).first()
    return _centroids([row[f"w{j}"] for j in range(c)], [[row[f"s{j}_{f}"] for f in range(n)] for j in range(c)]), float(np.sqrt(row["q"]))


def _arrow_step(points: DataFrame, new: Centroids | None, old: Centroids | None, c: int, n: int, m: float, tasks: int) -> tuple[Centroids, float]:
    """The same in numpy: a partial result per task. Those of FEW_TASKS go straight to the driver; more are added up by element before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(c + c * n + 1)
        a, b = (None if x is None else np.asarray(x, float) for x in (new, old))
        for batch in batches:
            x, start = _matrix(batch, "x", n), _matrix(batch, "u0", c)
            now = start if a is None else _numpy_membership(x, a, m)
            before = start if b is None else _numpy_membership(x, b, m)
            w = now**m
            sums[:c] += w.sum(axis=0)
            sums[c:-1] += (w.T @ x).ravel()
            sums[-1] += ((now - before) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["i", "v"])

    parts = points.select("x", "u0").mapInArrow(run, "i int, v double")
    found = np.zeros(c + c * n + 1)
    for r in (parts if tasks <= FEW_TASKS else parts.groupBy("i").agg(F.sum("v").alias("v"))).collect():
        found[r["i"]] += r["v"]
    return _centroids(found[:c].tolist(), found[c:-1].reshape(c, n).tolist()), float(np.sqrt(found[-1]))


# --- the loop -----------------------------------------------------------------------------------------------------


def fit(points: DataFrame, start: Start, m: float = FUZZINESS, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, form: str = "arrow") -> FcmResult:
    """Start's memberships give the first centroids; then memberships, change and centroids until the change is below epsilon.

    The points are cached for the loop, as every iteration reads them; a block lost with its executor is recomputed.
    """
    if form not in ("arrow", "flat"):
        raise ValueError(f"unknown form {form!r}")
    if m <= 1.0:
        raise ValueError("the fuzziness must be above 1")
    n, c = width(points), start.clusters
    if n == 0:
        raise ValueError("there are no points")
    own = start.apply(points.select("row_id", "x", *[k for k in points.columns if k == start.label]))
    if form == "flat":
        cached = flat(own.select("row_id", "x", *[F.col("u0")[j].alias(f"u0_{j}") for j in range(c)]), n).persist(StorageLevel.MEMORY_AND_DISK)
        step = _flat_step
    else:
        cached = own.select("x", "u0").persist(StorageLevel.MEMORY_AND_DISK)
        step = _arrow_step
    try:
        tasks = (cached.select(F.spark_partition_id().alias("k")).agg(F.max("k").alias("k")).first()["k"] or 0) + 1
        centroids, _ = step(cached, None, None, c, n, m, tasks)
        old, history = None, []
        for t in range(1, max_iterations + 1):
            fresh, delta = step(cached, centroids, old, c, n, m, tasks)
            old, centroids = centroids, fresh
            history.append((t, delta))
            if delta < epsilon:
                break
    finally:
        cached.unpersist()
    last = history[-1] if history else (0, float("inf"))
    return FcmResult(centroids, old, last[0], last[1], start, m, history)


def result_membership(points: DataFrame, result: FcmResult) -> DataFrame:
    """(row_id, u) as the loop left them: under the centroids before the last update."""
    if result.membership_centroids is None:
        return result.start.apply(points).select("row_id", F.col("u0").alias("u"))
    return membership(points, result.membership_centroids, result.fuzziness)


def hard_label(u: Column) -> Column:
    """The largest membership; of equal ones the first."""
    return (F.array_position(u, F.array_max(u)) - 1).cast("int")


def labels(memberships: DataFrame) -> DataFrame:
    return memberships.select("row_id", hard_label(F.col("u")).alias("label"))


def cluster_sizes(labelled: DataFrame, clusters: int) -> DataFrame:
    """(label, n) of every cluster, 0 for an empty one."""
    every = labelled.sparkSession.range(clusters).select(F.col("id").cast("int").alias("label"))
    return every.join(labelled.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def centroid_table(df: DataFrame, centroids: Centroids) -> DataFrame:
    """(j, f, v)."""
    rows = [(j, f, float(v)) for j, row in enumerate(centroids) for f, v in enumerate(row)]
    return df.sparkSession.createDataFrame(rows, "j int, f int, v double")


def history_table(df: DataFrame, result: FcmResult) -> DataFrame:
    """(iter, delta)."""
    return df.sparkSession.createDataFrame([(t, float(d)) for t, d in result.history], "iter int, delta double")


def progress(result: FcmResult) -> list[str]:
    """The lines a run reports: the first five iterations and every tenth."""
    return [f"iteration {t}: delta {d:.6e}" for t, d in result.history if t <= 5 or t % 10 == 0]


def summary(points: DataFrame, result: FcmResult, k: int = 5) -> dict:
    """Iterations, last change, cluster sizes and the memberships of the first k points."""
    u = result_membership(points, result)
    sizes = {r["label"]: r["n"] for r in cluster_sizes(labels(u), result.start.clusters).collect()}
    first = [(r["row_id"], list(r["u"])) for r in u.orderBy("row_id").limit(k).collect()]
    return {"iterations": result.iterations, "final_delta": result.final_delta, "sizes": sizes, "first": first}
