"""Mixing to target weights with soft membership.

A linear classifier over hashed byte n-grams, fitted on a labelled table, predicts for each document the probability of each
domain. A document with n tokens and posterior p counts n * p_d tokens towards domain d. Nonnegative rates r are
then fitted by projected gradient least squares, so that the expected totals sum(r * n * p_d) meet the targets
weight_d * budget:

    minimise |W (A r - target)|^2 over r >= 0,  A_di = n_i p_id,  W = (sum n p p')^(-1/2),  starting at r = 1.

In the variables sqrt(n) r the gradient step of length 1 is r <- max(0, r - p . l) with a vector l of one number per
domain (momentum is added to r before). So the state of the whole iteration is the list of those vectors: each step is
one aggregation that returns 2 D sums, rates are a function of a document's posterior and the list, and nothing else is
stored per document.

The classifier is fitted on at most max_rows labelled documents (a documented bound, picked by a hash of the id); the
posteriors, totals and rates cover every document and its whole text.

Defined cases: a document without tokens (null or empty text) has the domains' shares among the labels as posterior
and the rate 1, and changes no total; labels without a document or domain are ignored; without labels all domains are
equally likely; a target that no document can meet is approached as far as it goes, with a warning where the miss stays over HIGH_MISS; ids can be null or repeated, each
row has its own rate; other columns are ignored by rates() and kept by mix(); empty tables give empty results.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cumulo.llm.common import fresh, let_go, slices
from cumulo.llm.quality import labelled
from cumulo.session import cut

GRAM, BUCKET_BITS, MAX_ROWS = 5, 16, 4000
ITERATIONS, TOLERANCE = 40, 1e-6
#: A relative miss that is reported.
HIGH_MISS = 0.02
#: n-grams summed at once, and the factor from a text's mean weight to its logit.
SLAB, SHARPNESS = 1 << 20, 40.0
DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.92, "toxic": 0.02, "junk": 0.06}


# --- classifier ---------------------------------------------------------------------------------------------------


@dataclass
class Posterior:
    """weights: (buckets, domains); bias and prior: one number per domain."""

    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of each n-gram of the bytes (shorter texts are one n-gram, filled up with zeros)."""
    if len(raw) < GRAM:
        raw = np.concatenate([raw, np.zeros(GRAM - len(raw), np.uint8)])
    n = len(raw) - GRAM + 1
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _scale(n: int) -> float:
    """Logits are means over a text's n-grams, drawn towards the bias in short texts."""
    return float(np.sqrt(n * 200.0)) if n < 200 else float(n)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], domains: list[int], n_domains: int, epochs: int = 8, rate: float = 0.5, seed: int = 3) -> Posterior:
    """Multinomial logistic regression on n-gram shares by AdaGrad, in an order fixed by the seed."""
    rows = [(np.unique(_buckets(_raw(t)), return_counts=True), int(d)) for t, d in zip(texts, domains) if t]
    count = np.bincount([d for _, d in rows], minlength=n_domains).astype(float) if rows else np.zeros(n_domains)
    prior = (count + 1) / (count.sum() + n_domains)
    weights, bias = np.zeros((1 << BUCKET_BITS, n_domains), np.float32), np.log(prior).astype(np.float32)
    seen = np.full_like(weights, 1e-6)
    rng = np.random.default_rng(seed)
    shares = [(at, (n / _scale(n.sum())).astype(np.float32), d) for (at, n), d in rows]
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        for i in rng.permutation(len(shares)):
            at, x, d = shares[i]
            err = _softmax(x @ weights[at] * SHARPNESS + bias)
            err[d] -= 1
            g = x[:, None] * err
            seen[at] += g * g
            weights[at] -= step * g / np.sqrt(seen[at])
            bias -= 0.01 * err
    return Posterior(weights, bias, prior)


def posteriors(model: Posterior, texts: list[str | None]) -> np.ndarray:
    """(n, domains). A text's n-grams are summed in slabs, so that memory doesn't grow with its length."""
    out = np.tile(model.prior, (len(texts), 1))
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = _raw(t)
        total, n = np.zeros(len(model.bias)), 0
        for s in range(0, max(1, len(raw) - GRAM + 1), SLAB):
            at = _buckets(raw[s : s + SLAB + GRAM - 1])
            total += model.weights.take(at, axis=0).sum(axis=0, dtype=np.float64)
            n += len(at)
        out[i] = _softmax(total / _scale(n) * SHARPNESS + model.bias)
    return out


def fit(docs: DataFrame, domain_labels: DataFrame, n_domains: int, max_rows: int = MAX_ROWS) -> Posterior:
    """domain_labels: (doc_id, domain), domain from 0."""
    rows = labelled(docs, domain_labels.where(F.col("domain").between(0, n_domains - 1)), "domain", max_rows)
    model = train(rows["text"].tolist(), rows["cumulo_label"].tolist(), n_domains)
    let_go()
    return model


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the quality and toxic labels, in the order of DOMAINS; null where either is null."""
    domain = F.when(F.col("toxic").isNull() | F.col("quality").isNull(), F.lit(None)).when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0)
    return labels.select("doc_id", domain.cast("int").alias("domain"))


def _membership(model: Posterior):
    """n tokens, followed by the posterior, of each text."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def membership(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in slices(batches):
                rows = texts.tolist()
                n = np.array([len(t.split()) if t else 0 for t in rows], float)
                yield pd.Series(list(np.column_stack([n, posteriors(model, rows).round(6)])))
        finally:
            let_go()

    return membership


def memberships(docs: DataFrame, model: Posterior) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row."""
    m = docs.select("doc_id", _membership(model)("text").alias("m"))
    return m.select("doc_id", F.element_at("m", 1).cast("bigint").alias("n_tokens"), F.slice("m", 2, len(model.bias)).alias("posterior"))


# --- rates ----------------------------------------------------------------------------------------------------------


def rate_column(n_tokens: Column, posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after the steps (momentum, l): r <- max(0, y - p . l), y = r + momentum (r - the r before), from 1."""
    rate = F.lit(1.0)
    if steps:
        lits = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
        dot = lambda s: F.aggregate(F.zip_with(posterior, F.slice(s, 2, len(steps[0]) - 1), lambda p, v: p * v), F.lit(0.0), lambda a, v: a + v)
        move = lambda at, s: F.struct(F.greatest(F.lit(0.0), at["r"] + s[0] * (at["r"] - at["before"]) - dot(s)).alias("r"), at["r"].alias("before"))
        rate = F.aggregate(lits, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before")), move, lambda at: at["r"])
    return F.when(n_tokens > 0, rate).otherwise(F.lit(1.0))


def _rates_of(p: np.ndarray, steps: list[list[float]], momentum: float) -> tuple[np.ndarray, np.ndarray]:
    """(r, the point y where the next gradient is taken)."""
    r = before = np.ones(len(p))
    for beta, *l in steps:  # noqa: E741
        r, before = np.maximum(0.0, r + beta * (r - before) - p @ np.array(l)), r
    return r, r + momentum * (r - before)


def _totals(members: DataFrame, steps: list[list[float]], momentum: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The expected totals of the domains at r and at y: 2 D sums from each task, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * d)
        for b in batches:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            p = b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r, y = _rates_of(p, steps, momentum)
            sums += np.concatenate([(r * n) @ p, (y * n) @ p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * d, dtype=np.int32)), pa.array(sums)], names=["i", "v"])

    parts = members.select("n_tokens", "posterior").mapInArrow(run, "i int, v double")
    found = {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}
    got = np.array([found.get(i, 0.0) for i in range(2 * d)])
    return got[:d], got[d:]


def solve(members: DataFrame, targets: list[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], list[float]]:
    """(steps, relative miss after each number of steps). members should be materialised; it is read once per step.

    Projected gradient with momentum, which starts anew when the miss grows; the steps up to the least miss are returned. Where no step of
    the weighted metric helps, as with a domain that has hardly any mass, the plain gradient with the step 1 / L can't overshoot.
    """
    d = len(targets)
    if not all(np.isfinite(t) and t >= 0 for t in targets) or sum(targets) <= 0:
        raise ValueError("targets must be nonnegative numbers, not all of them 0")
    n, p = F.col("n_tokens").cast("double"), [F.element_at("posterior", k + 1) for k in range(d)]
    first = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i + 1)]).first()
    budget = float(first["n"] or 0)
    if budget == 0:
        return [], []
    gram = np.array([[first[f"g{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)], float)
    want = np.array(targets, float) / sum(targets) * budget
    steps, misses = _descend(members, want, np.linalg.pinv(gram, rcond=1e-12), iterations, tolerance)
    if not steps and misses[0] >= tolerance:
        steps, misses = _descend(members, want, np.eye(d) / np.linalg.eigvalsh(gram)[-1], iterations, tolerance)
    if min(misses) > HIGH_MISS:
        warnings.warn(f"mixing misses its targets by {min(misses):.3f} of the tokens", stacklevel=2)
    return steps, misses


def _descend(members: DataFrame, want: np.ndarray, inverse: np.ndarray, iterations: int, tolerance: float) -> tuple[list[list[float]], list[float]]:
    d, budget = len(want), float(want.sum())
    steps: list[list[float]] = []
    misses: list[float] = []
    momentum, t = 0.0, 1.0
    for _ in range(iterations + 1):
        at_r, at_y = _totals(members, steps, momentum, d)
        misses.append(float(np.abs(at_r - want).sum() / budget))
        if misses[-1] < tolerance or len(steps) == iterations:
            break
        if len(misses) > 1 and misses[-1] > misses[-2]:
            momentum, t, at_y = 0.0, 1.0, at_r
        steps.append([momentum, *(inverse @ (at_y - want)).tolist()])
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, t = (t - 1) / after, after
    return steps[: int(np.argmin(misses))], misses


def _check(model: Posterior, targets: list[float]) -> None:
    if len(targets) != len(model.bias):
        raise ValueError(f"{len(model.bias)} targets are needed, one for each domain")


def rates(docs: DataFrame, model: Posterior, targets: list[float]) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate) of every row."""
    _check(model, targets)
    members = cut(memberships(docs, model))
    steps, _ = solve(members, targets)
    return members.withColumn("rate", F.round(rate_column(F.col("n_tokens"), F.col("posterior"), steps), 6))


def raised(members: DataFrame, targets: list[float], keep: int) -> list[float]:
    """The targets, with the share of domain keep not below the one it has; the others make room in proportion."""
    n = F.col("n_tokens")
    row = members.agg(F.sum(n).alias("n"), F.sum(n * F.element_at("posterior", keep + 1)).alias("k")).first()
    shares = np.array(targets, float) / sum(targets)
    own = float(row["k"] / row["n"]) if row["n"] else 0.0
    rest = 1 - shares[keep]
    if own > shares[keep] and rest > 0:
        shares *= (1 - own) / rest
        shares[keep] = own
    return shares.tolist()


def mix(docs: DataFrame, model: Posterior, targets: list[float], keep: int | None = None) -> DataFrame:
    """docs with each row as often as its rate says; the fraction is decided by a hash of id and text.

    keep: a domain that doesn't lose: its target is at least its share, and documents that belong to it most have a rate of at least 1.

    Rows with the same id and text, repeated ones too, share one chance: each is there as often as the other.
    The texts are classified twice, once for the totals and once where the rows are written, so that no text is shuffled.
    """
    _check(model, targets)
    members = cut(memberships(docs, model))
    steps, _ = solve(members, targets if keep is None else raised(members, targets, keep))
    m, copies = fresh(docs, "cumulo_m"), fresh(docs, "cumulo_copies")
    rate = rate_column(F.element_at(m, 1), F.slice(m, 2, len(model.bias)), steps)
    if keep is not None:
        own = F.slice(m, 2, len(model.bias))
        rate = F.when(F.element_at(own, keep + 1) >= F.array_max(own), F.greatest(rate, F.lit(1.0))).otherwise(rate)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.withColumn(m, _membership(model)("text")).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.floor(rate + chance).cast("int")))).select(*docs.columns)
