"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand together inside no token of the vocabulary can never be merged across, whatever
the merges before. Each such pair in a text is therefore a certain cut: the fragments between the cuts are encoded
independently, distinct fragments seldom more than once per task, and their ids are concatenated. The result is exactly the
tokenizer's own, including its splitting pattern, because a cut is used only where the pattern's view of the rest doesn't depend on what
stands before it (not after white space, not before an apostrophe, not inside a character).

Decoding puts the tokens' bytes together. The vocabulary file is needed on the driver alone, which sends it to the workers.
A worker holds a slice of its batch's results at once, and at the end of a task only the vocabulary.

Defined cases: a null text has null ids, an empty one no ids; ids can be null or repeated, each row has its own
result; other columns are ignored by encode() and kept by add_tokens(); empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.llm.common import fresh, let_go, ship, shipped, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments in each of the two generations that a worker remembers during a task; the older one is then dropped, so that memory stays bounded.
REMEMBERED = 150_000
_WHITE_LAST = np.zeros(256, bool)
_WHITE_LAST[list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")] = True
#: Last bytes of white space outside ASCII; a cut after any byte that can end one isn't used.
_WHITE_LAST[[0x85, 0xA0, 0x80, 0x81, 0x82, 0x83, 0x84, 0x86, 0x87, 0x88, 0x89, 0x8A, 0xA8, 0xA9, 0xAF, 0x9F]] = True


def load_ranks(path: str) -> dict[bytes, int]:
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys()))
        self.split = regex.compile(PATTERN)
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                raw = np.frombuffer(token, np.uint8)
                inside[raw[:-1], raw[1:]] = True
        self.cut = ~inside
        self.cut[_WHITE_LAST] = False
        self.cut[:, ord("'")] = False
        self.cut[:, 0x80:0xC0] = False
        self.cut = self.cut.ravel()
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.before: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        b = np.frombuffer(raw, np.uint8)
        at = (np.flatnonzero(self.cut[b[:-1].astype(np.uint16) * 256 + b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece of the pattern: always the leftmost pair of least rank is merged next."""
        if word in self.ranks:
            return [self.ranks[word]]
        ranks, far = self.ranks, 1 << 62
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 200:
            return self._merge_long(parts)
        near = [ranks.get(word[i : i + 2], far) for i in range(len(word) - 1)]
        while near:
            least = min(near)
            if least == far:
                break
            i = near.index(least)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + joined, far)
            if i < len(near):
                near[i] = ranks.get(joined + parts[i + 1], far)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap and a linked list, for very long pieces."""
        ranks = self.ranks
        nxt, prev, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
        n = len(parts)

        def pair(i: int) -> tuple[int, int, bytes] | None:
            j = nxt[i]
            r = ranks.get(parts[i] + parts[j]) if j < n else None
            return None if r is None else (r, i, parts[i] + parts[j])

        heap = [p for p in map(pair, range(n)) if p]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or parts[i] + parts[nxt[i]] != joined:
                continue
            j = nxt[i]
            parts[i], alive[j], nxt[i] = joined, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [ranks[p] for p, a in zip(parts, alive) if a]

    def _missing(self, fragment: bytes) -> tuple[int, ...]:
        text = fragment.decode("utf-8")
        return tuple(i for piece in self.split.findall(text) for i in self.merge(piece.encode("utf-8")))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, ids = self.known, []
        for f in self.fragments(text.encode("utf-8", "replace")):
            found = known.get(f)
            if found is None:
                found = self.before.get(f)
                if found is None:
                    found = self._missing(f)
                if len(f) <= 64:
                    known[f] = found
            ids.extend(found)
        if len(known) >= REMEMBERED:
            self.before, self.known = known, {}
        return np.array(ids, np.int32)

    def forget(self) -> None:
        """Drops the remembered fragments; the worker may go on to stages that don't need them."""
        self.known, self.before = {}, {}
        let_go()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids if isinstance(ids, list) else ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(load_ranks(path))


def encode_column(spark: SparkSession, path: str = VOCABULARY):
    """path: the vocabulary on the driver; it is sent to the workers."""
    name = ship(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shipped(name))
        try:
            for texts in slices(batches):
                yield pa.array([None if t is None else own.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
        finally:
            own.forget()

    return encode


def decode_column(spark: SparkSession, path: str = VOCABULARY):
    name = ship(spark, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shipped(name))
        for ids in batches:
            yield pd.Series([None if i is None else own.decode(i) for i in ids], dtype=object)

    return decode


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of every row."""
    ids = docs.select("doc_id", encode_column(docs.sparkSession, path)("text").alias("token_ids"))
    return ids.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"))


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decodes): encoded and decoded again, in one pass over the texts."""
    name = ship(docs.sparkSession, path)

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(shipped(name))
        try:
            yield from rows(own, batches)
        finally:
            own.forget()

    def rows(own: Codec, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            ids = [None if t is None else own.encode(t) for t in b["text"]]
            back = [None if i is None else own.decode(i) == t for i, t in zip(ids, b["text"])]
            n = [None if i is None else len(i) for i in ids]
            yield pd.DataFrame({"doc_id": b["doc_id"], "token_ids": pd.Series(ids, dtype=object, index=b.index), "n_tokens": pd.Series(n, dtype="Int32", index=b.index), "decodes": pd.Series(back, dtype="boolean", index=b.index)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(both, f"doc_id {kind}, token_ids array<int>, n_tokens int, decodes boolean")


def add_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with its columns and token_ids (under a longer name where docs has one so named)."""
    return docs.withColumn(fresh(docs, "token_ids"), encode_column(docs.sparkSession, path)("text"))
