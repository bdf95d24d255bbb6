"""Document fingerprints by locally consistent parsing.

A text is its UTF-8 bytes, the symbols of level 0. Each level cuts its symbols into phrases and names every phrase by
a hash of its symbols; the names are the symbols of the next level:

1. A run of equal symbols becomes one symbol named by symbol and length, so that neighbours differ.
2. Deterministic coin tossing: a symbol's label is twice the lowest bit in which it differs from its left neighbour,
   plus its own value of that bit. Four rounds bring labels of 64 bits to fewer than 6, and neighbours still differ.
3. A phrase begins at each local maximum of the labels (and at the start of the text), so it has at most 11 symbols.
   A text of at most FEW symbols is one phrase, so that the levels come to an end.

A symbol's label depends on four symbols to its left, a phrase's start on one more to its right; so equal substrings
are cut alike, except near their ends, wherever they stand: they share the signatures of their interior. The last level
has one symbol, the name of the whole text.

Signatures are the phrases of LEVELS together: the lower level finds short common passages, the higher one says more about each.
A text that ends before has those of its deepest level with several phrases (its whole name if no level has). What is sure: n + 1 phrases
of a level need 11 more symbols than n, and 19 are lost at the ends, so any common passage of 3,858 bytes (runs counted once) shares a
signature of level 3, the worst case of all; how long passages of real text have to be is in the README.

Defined cases: a null or empty text has no signatures and a null fingerprint; ids can be null or repeated, each row has its
own result; other columns are ignored; empty tables give empty results. A worker needs about 60 bytes of memory for
each byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cumulo.llm.common import slices

#: The levels whose phrases are reported (about 15 and 37 bytes each), rounds of coin tossing, symbols that always are one phrase, bytes parsed at once.
LEVELS, ROUNDS, FEW, SLAB = (3, 4), 4, 8, 1 << 20
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(v: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers; works on a copy."""
    v = v ^ (v >> np.uint64(32))
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return v


def collapse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols as one symbol; first: whether a text starts here. Names of 64 bits."""
    new = first.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    length = np.diff(at, append=len(symbols)).astype(np.uint64)
    names = mix(symbols[at].astype(np.uint64) + K1)
    long = np.flatnonzero(length > 1)
    names[long] = mix(names[long] + length[long] * K2)
    return names, first[at]


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, no two neighbours of a text alike."""
    x = names
    for _ in range(ROUNDS):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = ~x[first]
        differ = x ^ left
        low = differ & (~differ + x.dtype.type(1))
        bit = np.bitwise_count(low - x.dtype.type(1))
        x = bit * np.uint8(2) + ((x & low) != 0).astype(np.uint8)
    return x


def begins(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a phrase begins."""
    last = np.append(first[1:], True)
    right = np.empty(len(labels), np.int8)
    right[:-1] = labels[1:]
    right[last] = -1
    left = np.empty(len(labels), np.int8)
    left[1:] = labels[:-1]
    left[first] = -1
    own = labels.astype(np.int8)
    return ((own > left) & (own > right)) | first


def next_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names, and which of them start a text."""
    names, first = collapse(symbols, first)
    begin = begins(toss(names, first), first)
    starts = np.flatnonzero(first)
    count = np.diff(starts, append=len(names))
    begin &= np.repeat(count > FEW, count) | first
    at = np.flatnonzero(begin)
    length = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, length) + 1
    parts = mix(names + place.astype(np.uint64) * K3)
    return mix(np.add.reduceat(parts, at) + length.astype(np.uint64) * K2), first[at]


def parse(texts: list[bytes], level: int) -> list[tuple[int, int, np.ndarray]]:
    """(fingerprint, levels, names of the level's phrases in order) of each text, none of them empty.

    A text with fewer levels has its fingerprint as its only phrase.
    """
    return [(f, d, own[level - 1] if d >= level else own[-1]) for f, d, own in hierarchy(texts, level)]


def sign(texts: list[bytes], levels: tuple[int, ...] = LEVELS) -> list[tuple[int, int, np.ndarray]]:
    """(fingerprint, levels, signatures) of each text, none of them empty: the phrases of the levels, each in the order of the text."""
    out = []
    for f, d, own in hierarchy(texts, max(levels)):
        several = [p for p in own if len(p) > 1]
        chosen = [own[k - 1] for k in levels if k <= len(own) and len(own[k - 1]) > 1]
        out.append((f, d, np.concatenate(chosen) if chosen else several[-1] if several else own[-1]))
    return out


def hierarchy(texts: list[bytes], most: int) -> list[tuple[int, int, list[np.ndarray]]]:
    """(fingerprint, levels, names of the phrases of each level up to most) of each text, none of them empty."""
    out: list = [None] * len(texts)
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    first = np.zeros(len(symbols), bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    owners, phrases, depth = np.arange(len(texts)), [[] for _ in texts], 0
    while len(owners):
        symbols, first = next_level(symbols, first)
        depth += 1
        starts = np.flatnonzero(first)
        count = np.diff(starts, append=len(symbols))
        if depth <= most:
            for o, s, c in zip(owners.tolist(), starts.tolist(), count.tolist()):
                phrases[o].append(symbols[s : s + c].view(np.int64))
        ended = count == 1
        for o, s in zip(owners[ended].tolist(), starts[ended].tolist()):
            out[o] = (int(symbols[s].view(np.int64)), depth, phrases[o])
        stay = np.repeat(~ended, count)
        symbols, first, owners = symbols[stay], first[stay], owners[~ended]
    return out


def slabs(texts: list[str | None], most: int = SLAB) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, own, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            rows.append(i)
            own.append(t.encode("utf-8", "replace"))
            size += len(own[-1])
            if size >= most:
                yield rows, own
                rows, own, size = [], [], 0
    if rows:
        yield rows, own


def fingerprints(docs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(doc_id, n_bytes, levels, fingerprint, signatures) of every row; signatures level by level, in the order of the text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts = b["text"].tolist()
            n = len(texts)
            names, depth, signs, size = [None] * n, [0] * n, [np.zeros(0, np.int64)] * n, [None if t is None else 0 for t in texts]
            for rows, own in slabs(texts):
                for i, raw, (f, d, p) in zip(rows, own, sign(own, levels)):
                    names[i], depth[i], signs[i], size[i] = f, d, p, len(raw)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": pd.Series(size, dtype="Int64", index=b.index), "levels": depth, "fingerprint": pd.Series(names, dtype="Int64", index=b.index), "signatures": pd.Series(signs, dtype=object, index=b.index)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes bigint, levels int, fingerprint bigint, signatures array<bigint>")
