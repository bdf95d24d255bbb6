"""Quality classifier, mixing, toxicity."""

import contextlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cumulo.llm import mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    d = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    return d.sample(frac=1, random_state=5).reset_index(drop=True)


# --- quality ---


def test_quality_accuracy_on_held_out_documents(labelled):
    train, test = labelled[:280], labelled[280:]
    net = quality.train(train["text"].tolist(), train["quality"].tolist())
    p = quality.predict(net, test["text"].tolist())
    good = test["quality"].to_numpy() == 1
    assert ((p >= quality.KEEP_FROM) == good).mean() > 0.92
    assert (p[good] >= quality.KEEP_FROM).mean() > 0.95


def slow_probability(net, text):
    """The definition, one window at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    halves = max(1, -(-len(raw) // quality.HALF))
    padded = np.concatenate([raw, np.zeros(halves * quality.HALF + quality.WINDOW - len(raw), np.uint8)])
    n = len(net.conv_b)
    best = []
    for h in range(halves):
        answers = []
        for w in range(h * quality.HALF, (h + 1) * quality.HALF, quality.STRIDE):
            y = net.conv_b.astype(float).copy()
            for b in range(quality.BLOCKS):
                vec = net.emb[padded[w + b * quality.STRIDE : w + (b + 1) * quality.STRIDE]].ravel()
                y += vec @ net.conv[:, b * n : (b + 1) * n]
            answers.append(np.maximum(y, 0))
        best.append(np.max(answers, axis=0))
    chunks = [np.maximum(a, b) for a, b in zip(best, best[1:])] or best
    hidden = np.max([np.tanh(c @ net.mid + net.mid_b) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(hidden @ net.out + net.out_b)[0]))


@pytest.mark.parametrize("n", [1, 11, 127, 128, 129, 256, 700])
def test_quality_equals_its_definition(n):
    net = quality.new_net(3)
    text = "".join(chr(97 + (i * i) % 26) for i in range(n))
    assert quality.predict(net, [text])[0] == pytest.approx(slow_probability(net, text), abs=1e-5)


def test_quality_pieces_of_long_texts_give_the_same(monkeypatch):
    net, text = quality.new_net(3), "abc d€f " * 3000
    whole = quality.predict(net, [text, "short"])
    monkeypatch.setattr(quality, "PIECE", 7)
    monkeypatch.setattr(quality, "SLAB", 2000)
    assert quality.predict(net, [text, "short"]) == pytest.approx(whole, abs=1e-6)


def test_quality_gradients():
    net = quality.new_net(1)
    pieces, target = [b"hello world, this is a text" * 9, b"1234!!"], np.array([1.0, 0.0], np.float32)

    def loss():
        p = np.clip(quality.predict(net, [x.decode() for x in pieces]), 1e-9, 1 - 1e-9)
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    grads = quality._gradients(net, pieces, target)
    for x, g in zip(net.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = x[at].copy()
        x[at] = old + 1e-3
        up = loss()
        x[at] = old - 1e-3
        down = loss()
        x[at] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[at]), rel=0.1, abs=1e-4)


def test_quality_edges(edges, labels, no_docs, no_labels):
    net = quality.fit(edges, labels)
    rows = quality.score(edges, net).collect()
    assert len(rows) == edges.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["p_quality"] == by_id[3]["p_quality"] == 0 and not by_id[2]["keep"]
    assert quality.filter_docs(edges, net).columns == edges.columns
    assert quality.score(no_docs, net).count() == 0
    free = quality.fit(edges, no_labels)
    assert free.constant == 1.0 and quality.filter_docs(edges, free).where("text IS NULL OR text = ''").count() == 0


def test_labelled_rows_are_picked_among_the_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(100)] + [(7, "again", "x")] * 50 + [(200, None, "x")], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id bigint, quality int")
    rows = quality.labelled(docs, labels, "quality", 2000)
    assert len(rows) == 100 and rows["doc_id"].tolist() == list(range(100)) and rows["text"][7] == "again" and rows["cumulo_label"].tolist() == [i % 2 for i in range(100)]
    assert len(quality.labelled(docs, labels, "quality", 30)) == 30


def test_quality_of_one_class(spark, edges):
    net = quality.fit(edges, spark.createDataFrame([(0, 0), (6, 0)], "doc_id bigint, quality int"))
    assert net.constant == 0.0 and quality.filter_docs(edges, net).count() == 0


# --- mixing ---


def slow_rates(tokens, post, targets, steps=400):
    """Projected gradient in sqrt(n) r over single documents, with the same weighting."""
    tokens, post, want = np.asarray(tokens, float), np.asarray(post), np.asarray(targets) / sum(targets) * sum(tokens)
    inverse = np.linalg.pinv((post * tokens[:, None]).T @ post, rcond=1e-12)
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.maximum(0, r - post @ (inverse @ ((r * tokens) @ post - want)))
    return r, want


@pytest.mark.parametrize("targets", [(0.5, 0.3, 0.2), (0.97, 0.02, 0.01), (0.1, 0.1, 0.8)])
def test_mixing_rates_meet_the_targets(spark, targets):
    rng = np.random.default_rng(0)
    post, tokens = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(n), p.tolist()) for i, (n, p) in enumerate(zip(tokens, post))], "doc_id bigint, n_tokens bigint, posterior array<double>")
    steps, misses = mixing.solve(df, list(targets))
    rate = df.select(mixing.rate_column(F.col("n_tokens"), F.col("posterior"), steps).alias("r")).toPandas()["r"].to_numpy()
    slow, want = slow_rates(tokens, post, targets)
    assert rate.min() >= 0
    slow_miss = np.abs((slow * tokens) @ post - want).sum() / want.sum()
    miss = np.abs((rate * tokens) @ post - want).sum() / want.sum()
    assert abs(miss - slow_miss) <= 0.01 and np.corrcoef(rate, slow)[0, 1] > 0.99
    assert len(steps) == int(np.argmin(misses))


@pytest.mark.parametrize("handful", [0, 3])
def test_mixing_takes_steps_with_a_domain_of_hardly_any_mass(spark, handful):
    rng = np.random.default_rng(1)
    toxic, junk = rng.beta(0.05, 0.9, 400), rng.random(400) * 1e-6
    junk[:handful] = 0.9
    post = np.column_stack([toxic, junk]) * [[1.0, 1.0]]
    post[:handful, 0] = 0.05
    post = np.column_stack([1 - post.sum(axis=1), post])
    df = spark.createDataFrame([(i, 50 + i % 90, p.tolist()) for i, p in enumerate(post)], "doc_id bigint, n_tokens bigint, posterior array<double>").cache()
    with pytest.warns(UserWarning) if not handful else contextlib.nullcontext():
        steps, misses = mixing.solve(df, [0.90, 0.02, 0.08] if not handful else [0.97, 0.02, 0.01])
    assert steps and min(misses) < misses[0]


def test_mixing_posteriors(labelled):
    domain = np.where(labelled["toxic"] == 1, 1, np.where(labelled["quality"] == 0, 2, 0))
    model = mixing.train(labelled["text"][:280].tolist(), domain[:280].tolist(), 3)
    p = mixing.posteriors(model, labelled["text"][280:].tolist())
    assert p.sum(axis=1) == pytest.approx(1)
    assert (p.argmax(axis=1) == domain[280:]).mean() > 0.78


def test_mixing_edges(edges, labels, no_docs, no_labels):
    model = mixing.fit(edges, mixing.label_domains(labels), 3)
    rows = {r["doc_id"]: r for r in mixing.rates(edges, model, [0.8, 0.1, 0.1]).collect()}
    assert rows[2]["rate"] == rows[3]["rate"] == 1.0 and rows[2]["n_tokens"] == 0
    assert list(rows[2]["posterior"]) == pytest.approx(model.prior, abs=1e-6)
    mixed = mixing.mix(edges, model, [0.8, 0.1, 0.1])
    assert mixed.columns == edges.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert times[2, None] == times[3, ""] == times[None, None] == 1
    for i, r in rows.items():
        texts = {t for k, t in times if k == i}
        for t in texts:
            copies = 2 if i == 0 else 1
            assert i is None or int(r["rate"]) * copies <= times[i, t] <= (int(r["rate"]) + 1) * copies and times[i, t] % copies == 0
    for bad in ([0.5, 0.5], [0, 0, 0], [1, -1, 1]):
        with pytest.raises(ValueError):
            mixing.mix(edges, model, bad)
    assert mixing.rates(no_docs, model, [1, 1, 1]).count() == 0 and mixing.mix(no_docs, model, [1, 1, 1]).count() == 0
    assert mixing.fit(edges, mixing.label_domains(no_labels), 3).prior == pytest.approx(1 / 3)


def test_mixing_copies_follow_rates(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20, "en", "s", 1) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = mixing.Posterior(np.zeros((1 << mixing.BUCKET_BITS, 2), np.float32), np.log([0.5, 0.5]), np.array([0.5, 0.5]))
    copies = mixing.mix(docs, model, [0.5, 0.5])
    assert copies.count() == 400 and copies.distinct().count() == 400


def test_mixing_keeps_every_clean_document(spark, labelled):
    labels = labelled.assign(domain=np.where(labelled["toxic"] == 1, 1, np.where(labelled["quality"] == 0, 2, 0)))
    model = mixing.train(labels["text"][:280].tolist(), labels["domain"][:280].tolist(), 3)
    clean = labels[labels["domain"] == 0]
    docs = spark.createDataFrame([(int(r.doc_id), r.text) for r in clean.itertuples()], "doc_id bigint, text string")
    first = mixing.posteriors(model, clean["text"].tolist()).argmax(axis=1) == 0
    kept = {r["doc_id"] for r in mixing.mix(docs, model, [0.6, 0.2, 0.2], keep=0).select("doc_id").collect()}
    assert {int(i) for i in clean["doc_id"][first]} <= kept
    members = spark.createDataFrame([(1, 10, [0.99, 0.006, 0.004])], "doc_id bigint, n_tokens bigint, posterior array<double>")
    assert mixing.raised(members, [0.97, 0.02, 0.01], 0) == pytest.approx([0.99, 0.02 / 3, 0.01 / 3])


# --- toxicity ---

LEXICON = toxicity.Lexicon({"idiot": 1.0, "clown": 0.5, "mor*": 0.25, "idiotic clown": 2.0}, ("class clown", "trash can"))


def slow_hits(lexicon, text):
    """All entries at all places, without an automaton."""
    t = toxicity.fold(text)
    edge = lambda i: i < 0 or i >= len(t) or not (t[i].isalnum() or t[i] == "_")
    spared = [(i, i + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for i in range(len(t)) if t.startswith(p, i) and edge(i - 1) and edge(i + len(p))]
    found = []
    for i in range(len(t)):
        if edge(i - 1):
            for entry, w in lexicon.entries.items():
                k = toxicity.fold(entry.rstrip("*"))
                if t.startswith(k, i) and (entry.endswith("*") or edge(i + len(k))):
                    found.append((i, -(i + len(k)), w))
    out, reach = [], 0
    for s, e, w in sorted(found):
        if s >= reach and not any(a <= s and -e <= b for a, b in spared):
            out.append((s, -e, w))
            reach = -e
    return out


TEXTS = ["You idiot!", "1d10t and сlоwn", "a class clown, a clown", "idiotic clown idiot", "clowns", "moron mormon mor", "ID|OT", "trash can", "", "c!own", "xidiot idiot_x idiot", "ïdiot", "id1ot" * 3, "ｉｄｉｏｔ"]


@pytest.mark.parametrize("text", TEXTS)
def test_toxicity_equals_brute_force(text):
    a = toxicity.automaton(LEXICON)
    assert toxicity.hits(a, toxicity.fold(text)) == slow_hits(LEXICON, text)


def test_toxicity_folds_and_spares():
    a = toxicity.automaton(LEXICON)
    assert toxicity.score_text(a, "1d10t")[1] == 1 and toxicity.score_text(a, "ідіот")[1] == 0 and toxicity.score_text(a, "іdіоt")[1] == 1
    assert toxicity.score_text(a, "the class clown")[1] == 0 and toxicity.score_text(a, "clown")[0] == 0.5 / toxicity.MIN_WORDS
    assert toxicity.score_text(a, "id\u200biot")[1] == 1 and toxicity.score_text(a, "i\u0307diot")[1] == 1 and toxicity.score_text(a, "İdiot")[1] == 1
    ass = toxicity.automaton(toxicity.Lexicon({"ass": 1.0}))
    assert [toxicity.score_text(ass, t)[1] for t in ("455 units", "a55", "@ss", "a$s", "4 5 5", "pass 455!")] == [0, 1, 1, 1, 0, 0]
    assert toxicity.score_text(ass, "schön año 2024")[1] == 0
    assert toxicity.score_text(a, None) == toxicity.score_text(a, "") == (0.0, 0)


def test_toxicity_finds_held_out_documents():
    rows = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id").dropna(subset=["text"])
    rows = rows.sample(frac=1, random_state=5).reset_index(drop=True)
    train, test = rows[:2500], rows[2500:]
    test = test[~test["text"].isin(set(train["text"]))]
    a = toxicity.automaton(toxicity.lexicon_from(train["text"].tolist(), train["toxic"].tolist()))
    s = np.array([toxicity.score_text(a, t)[0] for t in test["text"]])
    toxic = test["toxic"].to_numpy() == 1
    assert (s[toxic] >= toxicity.THRESHOLD).mean() > 0.87
    assert (s[~toxic] >= toxicity.THRESHOLD).mean() < 0.01


def test_mixing_posteriors_of_held_out_documents():
    rows = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id").dropna(subset=["text"])
    rows = rows.sample(frac=1, random_state=6).reset_index(drop=True)
    domain = np.where(rows["toxic"] == 1, 1, np.where(rows["quality"] == 0, 2, 0))
    model = mixing.train(rows["text"][:2500].tolist(), domain[:2500].tolist(), 3)
    test = ~rows["text"].isin(set(rows["text"][:2500]))
    p = mixing.posteriors(model, rows["text"][test].tolist())
    assert (p.argmax(axis=1) == domain[test]).mean() > 0.9


def test_toxicity_exceptions_in_a_long_text():
    import time

    a = toxicity.automaton(LEXICON)
    began = time.time()
    assert len(toxicity.hits(a, "class clown idiot " * 40_000)) == 40_000
    assert time.time() - began < 5


def test_toxicity_edges(edges, labels, no_docs, no_labels):
    rows = {r["doc_id"]: r for r in toxicity.score(edges, toxicity.learn(edges, no_labels)).collect()}
    assert rows[9]["toxic"] and rows[9]["hits"] == 4 and not rows[2]["toxic"] and rows[3]["score"] == 0 and not rows[5]["toxic"]
    assert toxicity.flagged(no_docs, toxicity.learn(no_docs, labels)).count() == 0
    assert toxicity.score(edges, toxicity.Lexicon({}, ())).where("toxic").count() == 0
