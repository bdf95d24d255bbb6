"""SimHash near-duplicates with the generalised pigeonhole principle.

Each document has WORDS independent 64-bit SimHashes of its set of words (of characters, in scripts without spaces), and a sketch: the SKETCH
least hashes of its runs of three words. Two documents are near-duplicates if one of their SimHashes differs in at most TAU bits (an edited copy that one
misses is found by another; SHORT_TAU bits if both are short) and the sketches put the share of common runs at SIMILAR or more (a pair that is alike in bits by
chance isn't). Groups are the connected components of that relation. For each SimHash the pairs are found exactly:

1. The correlations of the 64 bits over all distinct fingerprints are computed in one pass; a greedy walk puts
   correlated bits next to each other and cuts the order into m partitions.
2. If partition i gets the threshold t_i and the t_i add up to TAU - m + 1, each pair within TAU is within t_i in
   some partition i (t_i = -1: the partition is never probed). For each m, a dynamic program picks the t_i that cost least, counting
   the keys to be written and the candidates, which are estimated from histograms over all fingerprints; the cheapest m is used.
   So a larger corpus goes over to wider partitions with larger thresholds by itself.
3. Probe: a partition's value is looked up within t_i bits by a join on keys. The radius is shared between both sides
   (one side writes the ball of radius floor(t/2), the other that of ceil(t/2)); where t is even both are the same ball, which is
   written once and joined with itself. A key is one number that also tells its partition. Verify: the distance of all 64 bits.
   A pair is emitted in one canonical place only, so nothing has to be made distinct.

Documents that are equal in fingerprints and sketch are one node from the start, so a group of exact copies costs nothing. There is no cap on
partners or candidates.

Defined cases: a document without words (null, empty, only signs) has no fingerprints and is in no group; a null id
takes part and is carried as null, but represents a group only if no member has an id; a repeated row is a copy of itself and
forms no pair with itself; other columns are ignored by near_duplicates() and kept by deduplicate(); empty tables give
empty results. Of rows with the same id and text deduplicate() keeps the one whose columns have the least hash, so it doesn't depend on their order.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StructField, StructType

from cumulo.llm.common import fresh, let_go, slices
from cumulo.llm.parsing import mix
from cumulo.session import cut, written

BITS, TAU = 64, 8
#: SimHashes of a document, hashes in its sketch, words in a run, and the least estimated share of common runs.
WORDS, SKETCH, RUN, SIMILAR = 4, 64, 3, 0.3
#: The bits in which short texts (fewer than SKETCH runs) may differ: one word is more of them.
SHORT_TAU = 12
PARTITION_COUNTS = (3, 4, 5, 6)
#: Cost of a written key and of a joined candidate, in the same unit: a key is shuffled and sorted on either side.
KEY_COST, CANDIDATE_COST = 40.0, 1.0
MAX_THRESHOLD = 4
#: Keys that one job may write: passes that stay below it together are one job, so small tables don't pay for many; a larger pass is a job of its own.
JOB_KEYS = 4_000_000
#: Scripts that are written without spaces: each character is a word.
_SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f"
WORD = re.compile(f"[{_SINGLE}]|[^\\W{_SINGLE}]+")


# --- fingerprints -----------------------------------------------------------------------------------------------


def prints_of(texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
    """(WORDS signed 64-bit SimHashes of the set of lower-case words, sketch of the runs) of each text; None without words."""
    result: list = [None] * len(texts)
    digest = xxhash.xxh3_64_intdigest
    rows, hashes, sketches = [], [], []
    for i, t in enumerate(texts):
        words = WORD.findall(t.lower()) if t else []
        if not words:
            continue
        own = {w: digest(w) for w in set(words)}
        rows.append(i)
        hashes.append(np.fromiter(own.values(), np.uint64, len(own)))
        sketches.append(_sketch(np.fromiter((own[w] for w in words), np.uint64, len(words))))
    if not rows:
        return result
    sizes = np.array([len(h) for h in hashes])
    starts, together = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(hashes)
    words = []
    for k in range(WORDS):
        bits = np.unpackbits((_scramble(together, k) if k else together).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        words.append(np.packbits(ones * 2 > sizes[:, None], axis=1).view(np.int64).ravel())
    for i, v, sketch in zip(rows, np.column_stack(words).tolist(), sketches):
        result[i] = (v, sketch)
    return result


def _scramble(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of what was hashed."""
    return mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))


def _sketch(words: np.ndarray) -> list[int]:
    """The least hashes of the distinct runs of RUN words; a shorter text is one run."""
    if len(words) < RUN:
        words = np.concatenate([words, np.zeros(RUN - len(words), np.uint64)])
    n = len(words) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs = _scramble(runs, WORDS) ^ words[k : k + n]
    runs = np.unique((_scramble(runs, WORDS + 1) >> np.uint64(33)).astype(np.int32))
    return runs[:SKETCH].tolist()


def fingerprints_of(texts: list[str | None]) -> list[int | None]:
    """The first SimHash of each text; None without words."""
    return [p and p[0][0] for p in prints_of(texts)]


@F.pandas_udf(StructType([StructField("words", ArrayType(LongType())), StructField("sketch", ArrayType(IntegerType()))]))
def _print(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    try:
        for texts in slices(batches):
            found = prints_of(texts.tolist())
            yield pd.DataFrame({"words": pd.Series([p and p[0] for p in found], dtype=object), "sketch": pd.Series([p and p[1] for p in found], dtype=object)})
    finally:
        let_go()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, words, runs, sketch) of every row, a table in the shared folder: several passes read some of its columns.

    runs: the number of hashes in the sketch. node is null without words.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _print("text").alias("p"))
    rows = rows.select("doc_id", "text_hash", F.when(F.col("p.words").isNotNull(), F.xxhash64("p.words", "p.sketch")).alias("node"), "p.words", F.size("p.sketch").alias("runs"), "p.sketch")
    return written(rows, "simhash")


# --- plan: bit order, partitions, thresholds ----------------------------------------------------------------------


def _bit_counts(words: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """The number of rows, and for each SimHash and each two bits how many have both. The sums are added up where the rows are, so the driver gets as many whatever the input."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((count, BITS, BITS))
        for b in batches:
            for v in _columns(b["words"], count):
                for k in range(count):
                    x = _bits(v[:, k]).astype(np.float32)
                    both[k] += x.T @ x
                n += len(v)
        sums = np.append(both.ravel(), n).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "n": sums[at]})

    found = np.zeros(count * BITS * BITS + 1)
    rows = words.select("words").mapInPandas(local, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    found[rows["at"]] = rows["n"]
    return int(found[-1]), found[:-1].reshape(count, BITS, BITS)


def _columns(words: pd.Series, count: int) -> Iterator[np.ndarray]:
    """(rows, count) numbers, some thousand rows at once."""
    for s in range(0, len(words), 4096):
        yield np.stack(words[s : s + 4096].to_numpy())[:, :count].astype(np.int64)


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64), bit k of the value in column k."""
    return ((values.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def bit_order(n: int, both: np.ndarray) -> list[int]:
    """A greedy walk from bit 0, always to the bit not yet visited that correlates most with the last ones."""
    if n == 0:
        return list(range(BITS))
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    order, left = [0], set(range(1, BITS))
    while left:
        recent = corr[order[-4:]].sum(axis=0)
        nxt = max(left, key=lambda b: (recent[b], -b))
        order.append(nxt)
        left.remove(nxt)
    return order


def partitions_of(order: list[int], m: int) -> list[list[int]]:
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]


def _blocks(partition: list[int], most: int = 11) -> list[list[int]]:
    k = -(-len(partition) // most)
    cuts = [round(i * len(partition) / k) for i in range(k + 1)]
    return [partition[a:b] for a, b in zip(cuts, cuts[1:])]


def _histograms(words: DataFrame, blocks: list[tuple[int, list[int]]]) -> list[np.ndarray]:
    """How often each value of each block (SimHash, bits) occurs, over all rows; their size is fixed by the blocks."""
    count = max(k for k, _ in blocks) + 1

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 << len(b), np.int64) for _, b in blocks]
        for batch in batches:
            for v in _columns(batch["words"], count):
                x = [_bits(v[:, k]).astype(np.int64) for k in range(count)]
                for s, (k, b) in zip(sums, blocks):
                    s += np.bincount(x[k][:, b] @ (1 << np.arange(len(b))), minlength=len(s))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"block": i, "value": at, "n": s[at]})

    total = words.select("words").mapInPandas(local, "block int, value int, n bigint").groupBy("block", "value").agg(F.sum("n").alias("n"))
    found = [np.zeros(1 << len(b)) for _, b in blocks]
    rows = total.toPandas()
    for i, own in rows.groupby("block"):
        found[i][own["value"]] = own["n"]
    return found


def distance_shares(histogram: np.ndarray) -> np.ndarray:
    """The share of pairs at each distance, of values distributed as in the histogram."""
    w = len(histogram).bit_length() - 1
    at = np.zeros((w + 1, len(histogram)))
    at[0] = histogram
    for b in range(w):
        other = at[:, np.arange(len(histogram)) ^ (1 << b)]
        at[1:] += other[:-1]
    total = histogram.sum() ** 2
    return (at @ histogram) / (total or 1)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def _cost(n: int, width: int, shares: np.ndarray, t: int) -> float:
    """Keys written (those of both sides once where they are the same), and pairs that meet in a key (as often as they have keys in common)."""
    if t < 0:
        return 0.0
    small, large = t // 2, t - t // 2
    keys = n * (_ball(width, large) + (_ball(width, small) if small < large else 0))
    met = sum(share * _common(width, d, small, large) for d, share in enumerate(shares[: t + 1]))
    return KEY_COST * keys + CANDIDATE_COST * n * n * met


def _common(width: int, d: int, small: int, large: int) -> int:
    """The keys that two values d bits apart have in common: j of the d bits flipped on the small side, e others on both."""
    return sum(comb(d, j) * comb(width - d, e) for j in range(d + 1) for e in range(small + 1) if j + e <= small and d - j + e <= large)


def thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The cheapest t_i >= -1 that add up to total; costs[i][t + 1] is the cost of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, extra in enumerate(own):
                key, value = s + k - 1, c + extra
                if key not in nxt or value < nxt[key][0]:
                    nxt[key] = (value, [*ts, k - 1])
        best = nxt
    return best.get(total, (float("inf"), []))


def plans(words: DataFrame, count: int, tau: int = TAU) -> tuple[int, list[list[tuple[list[int], int]]]]:
    """The number of rows, and for each of the first SimHashes the bits and the threshold of each partition; two passes over words for all of them."""
    n, both = _bit_counts(words, count)
    options = [{m: partitions_of(bit_order(n, both[k]), m) for m in PARTITION_COUNTS} for k in range(count)]
    blocks = [(k, b) for k in range(count) for parts in options[k].values() for part in parts for b in _blocks(part)]
    shares = iter([distance_shares(h) for h in _histograms(words, blocks)])
    chosen = []
    for own_options in options:
        found = []
        for m, parts in own_options.items():
            costs = []
            for part in parts:
                own = np.ones(1)
                for _ in _blocks(part):
                    own = np.convolve(own, next(shares))
                costs.append([_cost(n, len(part), own, t) for t in range(-1, min(MAX_THRESHOLD, len(part)) + 1)])
            cost, ts = thresholds(costs, tau - m + 1)
            found.append((cost, m, ts))
        _, m, ts = min(found)
        if not ts:
            raise ValueError(f"no thresholds up to {MAX_THRESHOLD} reach {tau}")
        chosen.append(list(zip(own_options[m], ts)))
    return n, chosen


def plan(fps: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The bits and the threshold of each partition, for the fingerprints (fp)."""
    return plans(fps.select(F.array("fp").alias("words")), 1, tau)[1][0]


# --- probe and verify ---------------------------------------------------------------------------------------------


def _flips(bits: list[int], radius: int) -> list[int]:
    """The masks of at most radius of these bits, as signed 64-bit numbers."""
    masks = layer = [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << bits[j], j) for m, i in layer for j in range(i + 1, len(bits))]
        masks = masks + layer
    return [_signed(m) for m, _ in masks]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _tags(parts: list[list[int]]) -> list[int]:
    """For each partition a number on the bits outside it; two of them differ in the bits of any third partition, so keys of two partitions never meet."""
    tags = []
    for i in range(len(parts)):
        tags.append(_signed(sum(1 << bits[k] for j, bits in enumerate(parts) if j != i for k in range(3) if i >> k & 1)))
    return tags


def _keys(fps: DataFrame, parts: list[tuple[list[int], int, int]], fp: str) -> DataFrame:
    """(key, fp): for each probed partition (bits, tag, radius) the values within the radius, with the partition's tag on the other bits.

    The masks and flips are one constant array, so that the plan is small however many there are.
    """
    masks = [{"m": _mask(bits), "x": tag ^ f} for bits, tag, radius in parts for f in _flips(bits, radius)]
    each = F.explode(F.from_json(F.lit(json.dumps(masks)), "array<struct<m:bigint,x:bigint>>")).alias("e")
    return fps.select(F.col("fp").alias(fp), each).select(F.col(fp).bitwiseAND(F.col("e.m")).bitwiseXOR(F.col("e.x")).alias("key"), fp)


def pairs(fps: DataFrame, tau: int = TAU, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in at most tau bits, each once.

    Spark takes the keys for as small as the fingerprints that they are exploded from; unless it is told to merge, it sends them to the driver to broadcast them.
    """
    chosen = plan(fps, tau) if chosen is None else chosen
    probed = [(bits, tag, t) for (bits, t), tag in zip(chosen, _tags([bits for bits, _ in chosen])) if t >= 0]
    first, earlier = [], []
    for bits, tag, t in probed:
        x = f"((a ^ b) & {_long(_mask(bits))})"
        first.append(" AND ".join([f"key = ((a & {_long(_mask(bits))}) ^ {_long(tag)} ^ {_want(x, t)})", *earlier]))
        earlier.append(f"bit_count({x}) > {t}")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {tau} AND (({') OR ('.join(first)}))")
    found = None
    for odd in (0, 1):
        own = [(bits, tag, t) for bits, tag, t in probed if t % 2 == odd]
        if own:
            left = _keys(fps, [(bits, tag, t // 2) for bits, tag, t in own], "a")
            right = _keys(fps, [(bits, tag, t - t // 2) for bits, tag, t in own], "b")
            met = left.hint("merge").join(right.hint("merge"), "key").where(near).select("a", "b")
            found = met if found is None else found.unionByName(met)
    return found


def _want(x: str, t: int) -> str:
    """Of all keys where a pair meets, it counts at the one where side a flips only the lowest bits that side b can't: those bits of x, in SQL."""
    small, large = t // 2, t - t // 2
    parts, rest = [], x
    for k in range(small):
        low = f"({rest} & -{rest})"
        parts.append(f"CASE WHEN bit_count({x}) > {large + k} THEN {low} ELSE 0L END")
        rest = f"({rest} ^ {low})"
    return "(" + (" | ".join(parts) or "0L") + ")"


def _long(v: int) -> str:
    return f"({v}L)" if v > -(1 << 63) else "(-9223372036854775807L - 1L)"


# --- groups ----------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, by alternating large-star and small-star.

    Each round is cut in the shared folder; the number of rounds grows with the logarithm of the components' diameter.
    """
    edges = cut(edges.toDF("u", "v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = cut(small)
        if _mark(nxt) == _mark(edges):
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = nxt


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def similarity(a: str, b: str) -> Column:
    """The share of common runs, estimated from two sketches by the least hashes of their union; exact for short texts."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(least, F.col(a)), F.col(b))) / F.size(least)


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of passes whose result is in the shared folder."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def candidate_nodes(nodes: DataFrame, tau: int = TAU, searched: int = WORDS) -> DataFrame:
    """(u, v), u < v: the nodes (node, words, runs) that are within the bits by one of the first searched SimHashes.

    Each SimHash is a pass, and another over the short texts with their own threshold where all are searched. Passes end in the shared
    folder, several small ones together; then their shuffle files can go.
    """
    done, open_, keys = None, None, 0
    for some, most in [(nodes, tau)] + [(nodes.where(F.col("runs") < SKETCH), max(tau, SHORT_TAU))] * (searched == WORDS):
        n, chosen_each = plans(some, searched, most)
        for k, chosen in enumerate(chosen_each):
            own_keys = n * sum(_ball(len(bits), t - t // 2) for bits, t in chosen if t >= 0)
            if open_ is not None and keys + own_keys > JOB_KEYS:
                done, open_, keys = _union(done, cut(open_)), None, 0
                _free(nodes.sparkSession)
            open_, keys = _union(open_, _candidates(some.select("node", F.element_at("words", k + 1).alias("fp")), most, chosen)), keys + own_keys
    return _union(done, open_).distinct()


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _candidates(values: DataFrame, tau: int, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(u, v), u < v, of the nodes (node, fp) whose fingerprints differ in at most tau bits."""
    counts = values.groupBy("fp").agg(F.count("*").alias("n"))
    near = pairs(counts.select("fp"), tau, chosen).unionByName(counts.where("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    found = near.join(values.toDF("u", "a"), "a").join(values.toDF("v", "b"), "b").where("a <> b OR u < v")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_nodes(prints: DataFrame, tau: int = TAU, searched: int = WORDS) -> DataFrame:
    """(u, v), u < v: the nodes of prints (node, words, runs, sketch) that are near-duplicates. Only the sketches of candidates are read again."""
    known = prints.where("node IS NOT NULL")
    nodes = cut(known.groupBy("node").agg(F.first("words").alias("words"), F.first("runs").alias("runs")))
    met = cut(candidate_nodes(nodes, tau, searched))
    asked = met.select(F.col("u").alias("node")).unionByName(met.select(F.col("v").alias("node"))).distinct()
    own = known.select("node", "sketch").join(asked, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    both = met.join(own.toDF("u", "su"), "u").join(own.toDF("v", "sv"), "v")
    return cut(both.where(similarity("su", "sv") >= SIMILAR).select("u", "v"))


def _members(docs: DataFrame, tau: int, searched: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, node, root) of every document, the links between nodes (u, v)); root is null without words."""
    prints = fingerprints(docs)
    links = near_nodes(prints, tau, searched)
    rows = prints.select("doc_id", "text_hash", "node").join(components(links), "node", "left")
    return rows.select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root")), links


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, dup_of, n_links): a row for each document that has near-duplicates beside the one that stands for its class, the least id.

    n_links: the different texts that the document's text is linked to; 0 for an exact copy of texts linked to no other.
    """
    members, links = _members(docs, tau, WORDS)
    members = members.where("root IS NOT NULL")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    heads = members.groupBy("root").agg(F.min("doc_id").alias("dup_of"), F.count_distinct("doc_id").alias("n")).where("n > 1")
    rows = members.join(heads, "root").where("doc_id <> dup_of").join(degree, "node", "left")
    return rows.groupBy("doc_id", "dup_of").agg(F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))


def deduplicate(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row of each group (the least id; of rows with that id and text, one); rows without words all stay, repeated ones once.

    Groups are those of near_duplicates(). The texts are shuffled once.
    """
    members, _ = _members(docs, tau, WORDS)
    members = members.select("doc_id", "text_hash", F.coalesce("root", F.xxhash64("doc_id", "text_hash")).alias("root"), F.col("node").isNull().alias("wordless"))
    kept = members.groupBy("root", "wordless").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    k_id, k_hash, text_hash, n, row, k_row, order = (fresh(docs, x) for x in ("cumulo_id", "cumulo_hash", "cumulo_text_hash", "cumulo_n", "cumulo_row", "cumulo_k_row", "cumulo_order"))
    kept = kept.select(F.col("k.doc_id").alias(k_id), F.col("k.text_hash").alias(k_hash)).withColumn(k_row, F.xxhash64(k_id, k_hash))
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    keyed = docs.withColumns({order: F.xxhash64(*plain), text_hash: F.xxhash64("text")}).withColumn(row, F.xxhash64("doc_id", text_hash))
    joined = keyed.join(kept, (F.col(row) == F.col(k_row)) & F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(text_hash) == F.col(k_hash)))
    one = Window.partitionBy(row, "doc_id", text_hash).orderBy(order)
    return joined.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*docs.columns)
