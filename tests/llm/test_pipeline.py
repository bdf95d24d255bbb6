"""The pipeline against a brute-force version over plain rows, and its stages on awkward input."""

import re

import numpy as np
import pytest

import corpus_pipeline
from cumulo.llm import bpe, mixing, quality, secrets, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_pipeline(spark, sf):
    """Each stage's rule row by row, with the models that the stages fit."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    frame = lambda: spark.createDataFrame(rows, docs.select(*COLUMNS).schema)
    counts = [len(rows)]

    net = quality.fit(docs, labels)
    rows = [r for r in rows if quality.predict(net, [r[1]])[0] >= quality.KEEP_FROM]
    counts.append(len(rows))

    prints = simhash.prints_of([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = np.array([p[0] if p else [0] * simhash.WORDS for p in prints], np.int64).view(np.uint64)
    short = np.array([bool(p) and len(p[1]) < simhash.SKETCH for p in prints])
    bits = np.bitwise_count(u[:, None, :] ^ u[None, :, :]).min(axis=2)
    for i, j in zip(*np.nonzero(bits <= np.where(short[:, None] & short[None, :], simhash.SHORT_TAU, simhash.TAU))):
        if i < j and prints[i] and prints[j]:
            a, b = set(prints[i][1]), set(prints[j][1])
            least = sorted(a | b)[: simhash.SKETCH]
            if len(a & b & set(least)) / len(least) >= simhash.SIMILAR and find(i) != find(j):
                root[find(j)] = find(i)
    heads = {}
    for i, r in enumerate(rows):
        heads[find(i)] = min(heads.get(find(i), r), r, key=lambda x: x[0])
    rows = sorted(heads.values())
    counts.append(len(rows))

    def hide(text):
        marks = [""] * len(text)
        for rule in reversed(secrets.RULES):
            for m in re.finditer(rule.pattern, text):
                for k in range(*m.span(1)):
                    marks[k] = rule.name
        out, last = [], ""
        for c, mark in zip(text, marks):
            if mark == "":
                out.append(c)
            elif mark != last:
                out.append(f"[SECRET:{mark}]")
            last = mark
        return "".join(out)

    rows = [(r[0], hide(r[1]), *r[2:4], len(hide(r[1]))) for r in rows]
    counts.append(len(rows))

    model = mixing.fit(frame(), mixing.label_domains(labels), len(mixing.DOMAINS))
    tokens = np.array([len(r[1].split()) for r in rows], float)
    post = mixing.posteriors(model, [r[1] for r in rows]).round(6)
    want = np.array([corpus_pipeline.TARGETS[d] for d in mixing.DOMAINS]) * tokens.sum()
    inverse = np.linalg.pinv((post * tokens[:, None]).T @ post, rcond=1e-12)
    rate = np.ones(len(rows))
    for _ in range(3000):
        rate = np.maximum(0, rate - post @ (inverse @ ((rate * tokens) @ post - want)))
    return rows, rate, counts, (rate * tokens) @ post / tokens.sum()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    at = tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(i)))
        docs = spark.read.parquet(str(at / str(i)))
        out.append(docs)
    return out


def test_pipeline_equals_brute_force(spark, stages):
    rows, rate, counts, share = slow_pipeline(spark, SF)
    assert [s.count() for s in stages[:3]] == counts[1:4]
    assert sorted(tuple(r) for r in stages[2].select(*COLUMNS).collect()) == sorted(rows)
    copies = {}
    for r in stages[3].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for r, x in zip(rows, rate):
        assert int(np.floor(x - 0.02)) <= copies.get(r[0], 0) <= int(np.floor(x + 0.02)) + 1
    assert share[0] == pytest.approx(corpus_pipeline.TARGETS["clean"], abs=0.02)
    own = bpe.codec(bpe.VOCABULARY)
    last = stages[4].collect()
    assert len(last) == stages[3].count() and all(own.encode(r["text"]).tolist() == list(r["token_ids"]) for r in last)


def test_stages_return_the_columns_of_documents(stages):
    assert all(s.columns == COLUMNS for s in stages[:4]) and stages[4].columns == [*COLUMNS, "token_ids"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "secrets", "mix", "tokenize"]


def test_secrets_stage_keeps_a_ledger(spark, stages):
    settled = lambda: secrets.ledger_entries(corpus_pipeline.secret_ledger(spark).scans())
    texts = stages[1].select(secrets.blob_id("text").alias("blob")).distinct()
    assert settled().join(texts, "blob", "left_semi").count() == texts.count() * len(secrets.RULES)
    before, docs = settled().count(), stages[1]
    again = corpus_pipeline.hide_secrets(spark, docs.unionByName(docs.limit(1).withColumns({"doc_id": docs.doc_id * 0 - 1, "text": docs.doc_id.cast("string")})), SF)
    assert again.count() == docs.count() + 1 and settled().count() == before + len(secrets.RULES)
    assert sorted(map(str, again.where("doc_id >= 0").collect())) == sorted(map(str, stages[2].collect()))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[4].collect()))


@pytest.mark.parametrize("k", range(5))
def test_stage_on_awkward_rows(spark, edges, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, edges, SF)
    extra = ["token_ids_"] if name == "tokenize" else []
    assert got.columns == [*edges.columns, *extra]
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.select("doc_id", "text").collect())
    assert len(ids) == {"quality": len(ids), "dedup": 11, "mix": len(ids)}.get(name, edges.count())
    if name == "quality":
        assert all(t for _, _, t in ids) and ids
    if name == "dedup":
        assert len(set(ids)) == 11
    if name == "mix":
        assert {(False, 2, ""), (False, 3, ""), (True, 0, "")} <= set(ids)
    empty = stage(spark, no_docs, SF)
    assert empty.count() == 0 and empty.columns == [*no_docs.columns, *(["token_ids"] if extra else [])]
