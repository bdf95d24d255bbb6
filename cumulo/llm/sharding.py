"""Sharding by longest processing time: groups that must stay together, largest first, to the least-loaded shard.

The schedule is exactly that of one heap over all groups, taken by size (descending) and key (ascending), with the
lowest shard number among equal loads. But the heap sees no single group: groups of one size are interchangeable, so it works through the
histogram of sizes. While a size has many groups, the shards that are level take turns; whole rounds of such turns are one step. The result is a list of
phases (size, first rank, number of groups, shards in turn).

One task streams the sorted histogram past the heap (the schedule is sequential by nature) with nothing in memory but the shards; neither
it nor the driver holds the histogram or the phases. Groups are sorted by range of (size, key), so that a popular size is spread over tasks; a group's
rank within its size is its place in its range plus what earlier ranges hold of the size. Phases are looked up by size and by stretch of
STRETCH ranks, so no key of that join holds more groups than that.

Defined cases: a null key is a group like any other (first in key order); null or negative sizes count as 0; groups
of size 0 all go to one shard, the least loaded at the end; ids can be null or repeated, every row is in its group's
shard; more shards than groups leaves shards empty; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cumulo.session import cut, written

#: Shards; ranks of one size whose phase is looked up together; phases in a batch.
SHARDS, STRETCH, PHASES = 16, 65536, 4096


def phases(histogram: Iterable[tuple[int, int]], heap: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(size, first rank from 0, groups, shards in turn). histogram: (size, groups) by size, descending. heap: the shards' loads, changed in place."""
    shards = len(heap)
    for size, count in histogram:
        done = 0
        while done < count:
            left = count - done
            if size == 0:
                yield size, done, left, [heap[0][1]]
                break
            order = sorted(heap)
            level = [x for x in order if x < (order[0][0] + size, order[0][1])]
            rounds = left // len(level)
            if len(level) < shards:
                rounds = min(rounds, -(-(order[len(level)][0] - level[-1][0]) // size))
            if left <= 2 * shards or rounds == 0:
                turns = []
                for _ in range(min(left, 2 * shards)):
                    load, j = heap[0]
                    heapq.heapreplace(heap, (load + size, j))
                    turns.append(j)
                yield size, done, len(turns), turns
                done += len(turns)
            else:
                yield size, done, rounds * len(level), [j for _, j in level]
                done += rounds * len(level)
                heap[:] = [(load + rounds * size, j) for load, j in level] + order[len(level) :]
                heapq.heapify(heap)


def schedule(histogram: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """(phases, final loads) of a whole histogram."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    heap = [(0, j) for j in range(shards)]
    found = list(phases(histogram, heap))
    return found, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def phase_table(histogram: DataFrame, shards: int) -> DataFrame:
    """(size, start, n, turns) from the histogram (size, n): one task, which streams."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((size, n) for b in batches for size, n in zip(b.column("size").to_pylist(), b.column("n").to_pylist()))
        heap, pending = [(0, j) for j in range(shards)], []
        for p in phases(rows, heap):
            pending.append(p)
            if len(pending) == PHASES:
                yield _batch(pending)
                pending = []
        yield _batch(pending)

    return histogram.select("size", "n").repartition(1).sortWithinPartitions(F.desc("size")).mapInArrow(run, "size bigint, start bigint, n bigint, turns array<int>")


def _batch(found: list[tuple[int, int, int, list[int]]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], k) for i, k in enumerate(kinds)], names=["size", "start", "n", "turns"])


def ranked(groups: DataFrame) -> DataFrame:
    """groups (key, size) with rank: the place from 0 among the groups of that size, by key. The ranges are written, so that they are the same in both uses."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("size").to_numpy(zero_copy_only=False)
            first = np.append(True, size[1:] != size[:-1])
            start = np.flatnonzero(first)
            at = np.arange(len(size)) - np.repeat(start, np.diff(start, append=len(size)))
            if size[0] == last:
                head = start[1] if len(start) > 1 else len(size)
                at[:head] += run
            last, run = size[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "at"])

    order = [F.col("size").desc(), F.col("key").asc_nulls_first()]
    in_order = groups.select("key", "size").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    placed = written(in_order.mapInArrow(place, StructType([*in_order.schema.fields, StructField("at", LongType())])), "sharding")
    here = placed.groupBy("size", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offset = here.select("size", "range", F.coalesce(before, F.lit(0)).alias("before")).where("before > 0")
    return placed.join(offset, ["size", "range"], "left").select("key", "size", (F.col("at") + F.coalesce("before", F.lit(0))).alias("rank"))


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups: (key, size), one row per key. Returns (key, size, shard)."""
    table = cut(phase_table(groups.groupBy("size").agg(F.count("*").alias("n")), shards))
    stretch = lambda c: F.floor(c / F.lit(STRETCH))
    spread = table.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n") - 1))))
    placed = ranked(groups).withColumn("stretch", stretch(F.col("rank"))).join(spread, ["size", "stretch"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    return placed.select("key", "size", F.get("turns", ((F.col("rank") - F.col("start")) % F.size("turns")).cast("int")).alias("shard"))


def shard(df: DataFrame, key: Column, size: Column, shards: int = SHARDS, row_id: str = "doc_id") -> DataFrame:
    """(row_id, group_size, shard) of every row; key and size are columns of df."""
    rows = df.select(F.col(row_id), key.alias("key"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    placed = shard_groups(groups, shards).withColumnsRenamed({"key": "group_key", "size": "group_size"})
    return rows.join(placed, F.col("key").eqNullSafe(F.col("group_key"))).select(row_id, "group_size", "shard")


def shard_copies(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents with equal text stay together; the size is the length in characters."""
    return shard(docs, F.sha2(F.encode("text", "UTF-8"), 256), F.length("text"), shards)


def oracle_sql(shards: int = SHARDS) -> str:
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, sha256(text) AS k, coalesce(length(text), 0) AS s FROM documents),
groups_ AS (SELECT k, CAST(sum(s) AS BIGINT) AS size FROM rows_ GROUP BY k),
ordered AS (SELECT k, size, row_number() OVER (ORDER BY size DESC, k ASC NULLS FIRST) AS i FROM groups_),
lpt AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS k, CAST(0 AS BIGINT) AS size, 0 AS shard, list_transform(range({shards}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT o.i, o.k, o.size, CAST(list_position(l.loads, list_min(l.loads)) - 1 AS INTEGER),
    list_transform(l.loads, lambda v, j: v + CASE WHEN j = list_position(l.loads, list_min(l.loads)) THEN o.size ELSE 0 END)
  FROM lpt l JOIN ordered o ON o.i = l.i + 1)
SELECT r.doc_id, p.size AS group_size, p.shard FROM rows_ r JOIN (SELECT * FROM lpt WHERE i > 0) p ON r.k IS NOT DISTINCT FROM p.k
"""
