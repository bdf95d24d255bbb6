"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A text is its UTF-8 bytes. Every byte has a learned vector; learned filters of WINDOW bytes run at every STRIDE-th
byte of the whole text. Their responses are max-pooled inside overlapping chunks (of two neighbouring half chunks,
one half shared with the next chunk), a small layer turns each chunk's responses into hidden units, those are
max-pooled over all chunks of the document and combined into one probability. Long texts go through in pieces that
overlap by half a chunk, which gives the same maxima as one pass.

Training takes at most max_rows labelled documents (a documented bound; they are picked by a hash of the id). Prediction covers
every document and every byte.

Defined cases: a document without text (null or empty) has probability 0 and is not kept; labels that are null or
without a document are ignored; if the labelled documents are none or all of one class, nothing can be learned and
each text has that class's probability (1 without labels); ids can be null or repeated, each row has its own
result; other columns are ignored by score() and kept by filter_docs(); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import fresh, let_go, slices

STRIDE, BLOCKS, HALF = 4, 3, 128
WINDOW = STRIDE * BLOCKS
STEPS = HALF // STRIDE
PIECE, SLAB = 4096, 1 << 20
MAX_ROWS, KEEP_FROM = 2000, 0.3


@dataclass
class Net:
    """emb: byte vectors; conv: the filters' blocks side by side; mid: chunk layer; out: document layer. bias: used if nothing was learned."""

    emb: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    mid: np.ndarray
    mid_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray
    constant: float | None = None

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.conv_b, self.mid, self.mid_b, self.out, self.out_b]


def new_net(seed: int = 7, width: int = 6, filters: int = 24, hidden: int = 12) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    emb = draw(256, width, scale=0.5)
    emb[0] = 0
    return Net(emb, draw(STRIDE * width, BLOCKS * filters, scale=(WINDOW * width) ** -0.5), zero(filters), draw(filters, hidden, scale=filters**-0.5), zero(hidden), draw(hidden, scale=hidden**-0.5), zero(1))


def pieces_of(raw: bytes) -> list[bytes]:
    """The text in pieces of at most PIECE half chunks, overlapping by one, each followed by what its last window still sees."""
    halves = max(1, -(-len(raw) // HALF))
    if halves <= PIECE:
        return [raw]
    return [raw[s * HALF : min(s + PIECE, halves) * HALF + WINDOW] for s in range(0, halves - 1, PIECE - 1)]


def _lay_out(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, each with a spare half chunk of zeros at its end; the halves that make each chunk; each piece's first chunk."""
    halves = np.array([min(PIECE, max(1, -(-len(p) // HALF))) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(halves + 1)])
    flat = np.zeros(starts[-1] * HALF, np.uint8)
    for p, s in zip(pieces, starts):
        flat[s * HALF : s * HALF + len(p)] = np.frombuffer(p, np.uint8)
    chunks = np.maximum(1, halves - 1)
    offset = np.concatenate([[0], np.cumsum(chunks)])
    first = np.repeat(starts[:-1] - offset[:-1], chunks) + np.arange(offset[-1])
    second = first + np.repeat(halves > 1, chunks)
    return flat, first, second, offset[:-1]


def _convolve(net: Net, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte blocks' vectors and the filters' responses, one row for each STRIDE bytes."""
    blocks = net.emb[flat].reshape(len(flat) // STRIDE, -1)
    parts = blocks @ net.conv
    n = len(net.conv_b)
    y = parts[:, :n] + net.conv_b
    for k in range(1, BLOCKS):
        y[:-k] += parts[k:, k * n : (k + 1) * n]
    return blocks, y


def _hidden(net: Net, pieces: list[bytes]) -> np.ndarray:
    """Each piece's hidden units, max-pooled over its chunks."""
    flat, first, second, offset = _lay_out(pieces)
    _, y = _convolve(net, flat)
    half = np.maximum(y.reshape(-1, STEPS, y.shape[1]).max(axis=1), 0)
    return np.maximum.reduceat(np.tanh(np.maximum(half[first], half[second]) @ net.mid + net.mid_b), offset)


def predict(net: Net, texts: list[str | None]) -> np.ndarray:
    """The probability of each text."""
    result = np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t]
    if not rows:
        return result
    if net.constant is not None:
        result[rows] = net.constant
        return result
    owner, pending, size, done = [], [], 0, []
    for k, i in enumerate(rows):
        for p in pieces_of(texts[i].encode("utf-8", "replace")):
            owner.append(k)
            pending.append(p)
            size += len(p) + 2 * HALF
            if size >= SLAB:
                done.append(_hidden(net, pending))
                pending, size = [], 0
    if pending:
        done.append(_hidden(net, pending))
    pooled = np.maximum.reduceat(np.concatenate(done), np.flatnonzero(np.diff([-1, *owner])))
    logit = (pooled @ net.out + net.out_b).astype(np.float64)
    result[rows] = 1 / (1 + np.exp(-logit))
    return result


def _gradients(net: Net, pieces: list[bytes], target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; a piece of a very long document counts as an example of its own."""
    flat, first, second, offset = _lay_out(pieces)
    blocks, y = _convolve(net, flat)
    n = y.shape[1]
    by_half = y.reshape(-1, STEPS, n)
    at = by_half.argmax(axis=1)
    half = np.maximum(np.take_along_axis(by_half, at[:, None], 1)[:, 0], 0)
    a, b = half[first], half[second]
    chunk = np.maximum(a, b)
    hid = np.tanh(chunk @ net.mid + net.mid_b)
    ends = np.append(offset[1:], len(hid))
    best = np.stack([s + hid[s:e].argmax(axis=0) for s, e in zip(offset, ends)])
    units = np.arange(hid.shape[1])
    pooled = hid[best, units]
    p = 1 / (1 + np.exp(-(pooled @ net.out + net.out_b)))
    d = ((p - target) / len(target)).astype(np.float32)
    d_pre = np.zeros_like(hid)
    d_pre[best, units] = d[:, None] * net.out * (1 - pooled**2)
    d_chunk = d_pre @ net.mid.T
    d_chunk[chunk <= 0] = 0
    winner = np.where(a >= b, first[:, None], second[:, None])
    d_y = np.zeros_like(y)
    c, f = np.nonzero(d_chunk)
    h = winner[c, f]
    np.add.at(d_y, (h * STEPS + at[h, f], f), d_chunk[c, f])
    d_parts = np.zeros((len(y), BLOCKS * n), np.float32)
    for k in range(BLOCKS):
        d_parts[k:, k * n : (k + 1) * n] = d_y[: len(y) - k]
    d_bytes = (d_parts @ net.conv.T).reshape(len(flat), -1)
    d_emb = np.stack([np.bincount(flat, d_bytes[:, j], 256) for j in range(d_bytes.shape[1])], axis=1)
    d_emb[0] = 0
    return [d_emb.astype(np.float32), blocks.T @ d_parts, d_y.sum(0), chunk.T @ d_pre, d_pre.sum(0), pooled.T @ d, np.array([d.sum()], np.float32)]


def train(texts: list[str | None], good: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the log loss, in an order fixed by the seed."""
    rows = [(t.encode("utf-8", "replace"), int(g)) for t, g in zip(texts, good) if t]
    net = new_net(seed)
    share = float(np.mean([g for _, g in rows])) if rows else 1.0
    if share in (0.0, 1.0):
        net.constant = share
        return net
    rng = np.random.default_rng(seed)
    params = net.params()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            picked = [rows[i] for i in order[s : s + batch]]
            owned = [(p, g) for raw, g in picked for p in pieces_of(raw)]
            grads = _gradients(net, [p for p, _ in owned], np.array([g for _, g in owned], np.float32))
            step += 1
            lr = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for x, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                x -= (lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    """(doc_id, text, label) of at most max_rows labelled ids that have a text, in an order that doesn't depend on partitions.

    The ids are picked among those with a text, so fewer than max_rows come only where there are no more; they are at most max_rows whatever the input,
    so that they can be broadcast. An id with several labels counts with the lowest; an id with several texts with the first in order, which is
    found where the rows are: the driver gets a row per picked id.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("cumulo_label"))
    with_text = docs.where(F.col("text").isNotNull()).select("doc_id")
    picked = ids.join(with_text, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("cumulo_label").alias("cumulo_label")).toPandas().sort_values("doc_id").reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Net:
    rows = labelled(docs, labels, label, max_rows)
    net = train(rows["text"].tolist(), rows["cumulo_label"].tolist())
    let_go()
    return net


def score_column(net: Net):
    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in slices(batches):
                yield pd.Series(predict(net, texts.tolist()))
        finally:
            let_go()

    return probability


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, p_quality, keep) of every row."""
    scored = docs.select("doc_id", score_column(net)("text").alias("p_quality"))
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), (F.col("p_quality") >= KEEP_FROM).alias("keep"))


def filter_docs(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns as they are."""
    p = fresh(docs, "cumulo_p")
    return docs.withColumn(p, score_column(net)("text")).where(F.col(p) >= KEEP_FROM).drop(p)
