"""Exact top-k search by a three-phase uniform threshold: the stated queries against all rows, in blocks.

The cosine of two vectors is the sum of its parts over BLOCKS blocks of dimensions. A node is one block of a tile of objects; it
holds its slice of those vectors and nothing of their other dimensions, and gets the same slice of the query tiles.

1. Each node sends, for each query, its local list: the k + 1 best by part score. Per query and block the best of all nodes
   are kept, their full scores are fetched, and the least of the k + 1 best is a safe cutoff: the true one isn't lower.
2. The cutoff goes back to the nodes with the query tiles. A vector whose parts all are below cutoff / BLOCKS can't reach
   it, so each node sends just the entries at or above that share. The entries of a vector are added up, the share in the place of parts
   that weren't sent; what stays below the cutoff is dropped.
3. The full scores of what is left are computed in double precision, and the best are the result.

Equal vectors are one object (and one query), however many ids have them: the k + 1 least ids stand for them, as no list can hold more, so
copies cost nothing and none of them is lost. Query tiles go to object tiles in groups of GROUP, so a task's work and memory don't depend on
the number of vectors. The parts are computed in single precision; the comparisons allow for that (SLACK), so the result is exact.
Equal scores are ordered by id.

Defined cases: rows with a null id, a null or empty vector, a null or non-finite component, or not of the most frequent length
(of several the largest) are no vectors, and a warning says how many have another length; an id that is repeated counts once, with its
least vector; a zero vector has score 0 to all; fewer than k + 1 vectors give each query all others; a vector isn't its own neighbour, an
equal one with another id is; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.session import cut

K, BLOCKS, SLACK = 10, 2, 1e-4
#: Rows of an object tile and of a query tile, query tiles that meet an object tile in one task, and queries multiplied at once.
TILE, QUERY_TILE, GROUP, ROWS = 8192, 2048, 16, 512
#: One of so many ids is a query.
EVERY = 20


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """((id, v), number of vectors, dimensions)."""
    v = F.col(vec_col).cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    by_length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most"), F.sum("n").alias("all")).first()
    if by_length["most"] is None:
        return rows, 0, 1
    n, d = by_length["most"]["n"], by_length["most"]["d"]
    if by_length["all"] > n:
        warnings.warn(f"{by_length['all'] - n} vectors don't have {d} dimensions and are left out", stacklevel=2)
    return rows.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), n, d


def objects(rows: DataFrame, k: int, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """((id, v, ids, asked), (id, query)): the distinct vectors, each under its least id with its k + 1 least ids and whether a query has it; the
    queries and the object that each of them is."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    same = placed.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    found = same.select(F.element_at("ids", 1).alias("id"), "v", "ids")
    queries = rows.where(is_query).join(found.select(F.col("id").alias("object"), F.col("v").alias("w")), F.col("v") == F.col("w")).select("object", F.col("id").alias("query"))
    queries = cut(queries)
    asked = queries.select(F.col("object").alias("id")).distinct().withColumn("asked", F.lit(True))
    return cut(found.join(asked, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))), queries


# --- tiles and nodes --------------------------------------------------------------------------------------------------


def _blocks(d: int) -> list[slice]:
    cuts = [round(i * d / BLOCKS) for i in range(BLOCKS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _tile_of(tiles: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")


def slices(rows: DataFrame, tiles: int, d: int) -> DataFrame:
    """(tile, block, ids, vs): each block of dimensions of each tile, packed in single precision."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        unit, ids = _unit(np.stack(pdf["v"].to_numpy())).astype(np.float32), pdf["id"].to_numpy(np.int64).tobytes()
        parts = [np.ascontiguousarray(unit[:, b]).tobytes() for b in _blocks(d)]
        return pd.DataFrame({"tile": pdf["tile"].iloc[0], "block": range(len(parts)), "ids": [ids] * len(parts), "vs": parts})

    return rows.select("id", "v", _tile_of(tiles).alias("tile")).groupBy("tile").applyInPandas(pack, "tile int, block int, ids binary, vs binary")


def _spread(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _at_nodes(asked: DataFrame, held: DataFrame, q_tiles: int, o_tiles: int) -> DataFrame:
    """Each node with each query tile of a group: query tiles go to all object tiles, object tiles to all groups."""
    groups = -(-q_tiles // GROUP)
    left = asked.withColumn("ot", _spread(o_tiles)).withColumn("qg", F.floor(F.col("qt") / F.lit(GROUP)).cast("int"))
    right = held.select(F.col("tile").alias("ot"), "block", F.col("ids").alias("o_ids"), F.col("vs").alias("o_vs")).withColumn("qg", _spread(groups))
    return left.join(right, ["ot", "block", "qg"])


def _per_node(f: Callable[..., pd.DataFrame], *given: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield f(r, *given)

    return run


def _slice(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vs, np.float32).reshape(len(own), -1)


def _local_list(r, k: int) -> pd.DataFrame:
    """Phase 1 at a node: the k + 1 best part scores of each query."""
    (q_ids, q), (o_ids, o) = _slice(r.q_ids, r.q_vs), _slice(r.o_ids, r.o_vs)
    most, found = min(k + 1, len(o_ids)), []
    for s in range(0, len(q), ROWS):
        part = q[s : s + ROWS] @ o.T
        at = np.argpartition(part, len(o_ids) - most, axis=1)[:, len(o_ids) - most :] if most < len(o_ids) else np.tile(np.arange(most), (len(part), 1))
        found.append((np.repeat(q_ids[s : s + ROWS], most), o_ids[at.ravel()], np.take_along_axis(part, at, 1).ravel()))
    a, b, c = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"q": a, "block": np.int32(r.block), "o": b, "part": c})


def _entries(r, blocks: int) -> pd.DataFrame:
    """Phase 2 at a node: what reaches the query's share of its cutoff."""
    (q_ids, q), (o_ids, o) = _slice(r.q_ids, r.q_vs), _slice(r.o_ids, r.o_vs)
    share = ((np.frombuffer(r.cutoffs, np.float64) - SLACK) / blocks).astype(np.float32)
    found = []
    for s in range(0, len(q), ROWS):
        part = q[s : s + ROWS] @ o.T
        qi, oi = np.nonzero(part >= share[s : s + ROWS, None])
        found.append((q_ids[qi + s], o_ids[oi], part[qi, oi], share[qi + s]))
    a, b, c, e = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"q": a, "o": b, "part": c, "share": e})


def _pack_cutoffs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cutoffs of a tile's queries in the order of its ids."""
    return pd.DataFrame({"qt": [pdf["qt"].iloc[0]], "cutoffs": [pdf.sort_values("id")["cutoff"].to_numpy(np.float64).tobytes()]})


def full_scores(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(q, o, score) of pairs of objects, in double precision; equal vectors get equal scores wherever they stand."""

    def rows(column: pa.Array, n: int) -> np.ndarray:
        return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            score = (rows(b.column("qv"), n) * rows(b.column("ov"), n)).sum(axis=1) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("o"), pa.array(score)], names=["q", "o", "score"])

    asked = found.where("asked").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    both = pairs.select("q", "o").join(asked, "q").join(found.select(F.col("id").alias("o"), F.col("v").alias("ov")), "o")
    return both.select("q", "o", "qv", "ov").mapInArrow(run, "q bigint, o bigint, score double")


# --- the search -------------------------------------------------------------------------------------------------------


def candidates(found: DataFrame, n: int, n_queries: int, d: int, k: int, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """(q, o, score): for each object that is asked for, the objects that can be among its k + 1 best ids; the outcome of all three phases."""
    o_tiles, q_tiles = max(1, -(-n // tile)), max(1, -(-n_queries // query_tile))
    held = cut(slices(found, o_tiles, d))
    asked = cut(slices(found.where("asked"), q_tiles, d)).select(F.col("tile").alias("qt"), "block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))

    lists = _at_nodes(asked, held, q_tiles, o_tiles).mapInPandas(_per_node(_local_list, k), "q bigint, block int, o bigint, part float")
    best = F.row_number().over(Window.partitionBy("q", "block").orderBy(F.desc("part"), "o"))
    known = full_scores(lists.withColumn("place", best).where(F.col("place") <= k + 1).select("q", "o").distinct(), found)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "o"))
    cutoff = F.when(F.count("*") == k + 1, F.min("score")).otherwise(F.lit(-2.0))
    cutoffs = cut(known.withColumn("place", place).where(F.col("place") <= k + 1).groupBy(F.col("q").alias("id")).agg(cutoff.alias("cutoff")))

    packed = cutoffs.withColumn("qt", _tile_of(q_tiles)).groupBy("qt").applyInPandas(_pack_cutoffs, "qt int, cutoffs binary")
    n_blocks = len(_blocks(d))
    sent = _at_nodes(asked.join(packed, "qt"), held, q_tiles, o_tiles).mapInPandas(_per_node(_entries, n_blocks), "q bigint, o bigint, part float, share float")
    added = sent.groupBy("q", "o").agg((F.sum("part") + F.first("share") * (F.lit(n_blocks) - F.count("*"))).alias("most"))
    held_on = added.join(cutoffs.withColumnRenamed("id", "q"), "q").where(F.col("most") >= F.col("cutoff") - F.lit(2 * SLACK))

    return full_scores(held_on, found).join(cutoffs.withColumnRenamed("id", "q"), "q").where(F.col("score") >= F.col("cutoff") - F.lit(1e-12)).select("q", "o", "score")


def top_k(df: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """(id, rank, neighbor, score): the k nearest others by cosine of every row whose id is divisible by every, among all rows."""
    rows, n, d = vectors(df, id_col, vec_col)
    found, queries = objects(rows, k, F.col("id") % F.lit(every) == 0)
    got = candidates(found, n, -(-n // every), d, k, tile, query_tile)
    ids = got.join(found.select(F.col("id").alias("o"), "ids"), "o").select("q", "score", F.explode("ids").alias("neighbor"))
    near = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "neighbor"))
    nearest = ids.withColumn("near", near).where(F.col("near") <= k + 1)
    lists = queries.join(nearest, F.col("object") == F.col("q")).where(F.col("query") != F.col("neighbor"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("near"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("id"), "rank", "neighbor", "score")


ORACLE_SQL = f"""
SELECT vec_id, rank, neighbor_id, round(s, 6) AS score FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
WHERE rank <= {K}
"""
