"""Memberships of points that arrive as a stream, under centroids that are fixed.

The reference computation is all batch; this is the one step of it that needs no state, so the batch expression runs on a stream as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cumulo.operators.fcm import FUZZINESS, Centroids, hard_label, membership


def assign(points: DataFrame, centroids: Centroids, m: float = FUZZINESS) -> DataFrame:
    """(row_id, u, label) of a streaming or static points(row_id, x)."""
    u = membership(points, centroids, m)
    return u.withColumn("label", hard_label(u["u"]))


def write_assignments(points: DataFrame, centroids: Centroids, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's assignments as Parquet; the checkpoint makes every point count once."""
    return assign(points, centroids).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
