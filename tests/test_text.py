"""Text features, sources, sinks, the run, the command line and streaming."""

import math

import pytest
from pyspark.sql import functions as F

from cumulo import queries
from cumulo.__main__ import settings_from
from cumulo.functions import text
from cumulo.operators import corpus, entities, fcm, init, profile, tfidf
from cumulo.plans import clustering, text_features
from cumulo.sources import files
from cumulo.streaming.assign import write_assignments


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f, value, expected",
    [
        (text.clean, "BP 120/80 at 9.5  x2\n end ", "BP / at x2 end"),
        (text.strip, " \t a b  ", "a b"),
        (text.entity_name, "  Chest \n Pain ", "chest_pain"),
        (text.words, "Ab a c_1 É! été", ["ab", "c_1", "été"]),
        (text.pieces, " A-b  c ", ["a-b", "c"]),
    ],
)
def test_text_functions(spark, f, value, expected):
    assert one(spark, f(F.col("t")), value) == expected


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r["r"] for r in df.select(text.ngram_range(F.col("t"), 1, 2).alias("r")).collect()] == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_filters(spark):
    rows = [None, "x" * 50, "x" * 51, "x" * 99, "x" * 100, " " * 60 + "y"]
    r = corpus.filter_counts(spark.createDataFrame([(t,) for t in rows], "text string")).first()
    assert (r["n_rows"], r["null_dropped"], r["short_dropped"], r["body_dropped"], r["long_kept"], r["body_kept"]) == (6, 1, 4, 2, 1, 3)


def test_entities_and_negation(spark):
    docs = spark.createDataFrame([(1, "Patient has chest pain but no fever. She denies shortness of breath. Chest pain without fever!"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in entities.entity_bags(docs).collect()}
    assert got == {1: ["chest_pain", "NEG_fever", "NEG_shortness", "NEG_breath"], 3: []}
    assert entities.non_empty(entities.entity_bags(docs).cache()).count() == 1

    def model(texts):
        return [[entities.Entity("Fever", "chunk"), entities.Entity(" fever ", "entity", "DISEASE", True), entities.Entity("Paris", "entity", "GPE"), entities.Entity("ab", "chunk"), entities.Entity("He", "chunk"), entities.Entity("history")] for _ in texts]

    assert entities.entity_bags(docs, model).where("doc_id = 1").first()["tokens"] == ["NEG_fever"]
    r = corpus.token_stats(entities.entity_bags(docs)).first()
    assert (r["n_docs"], r["with_tokens"], r["mean_tokens"]) == (2, 1, 4.0)


def test_entity_bags_hold_few_texts_at_a_time(spark):
    """bags leave the worker a few at a time, however many rows an Arrow batch has."""
    docs = spark.range(200, numPartitions=1).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("red fox and blue dog"), "id").alias("text"))

    bags = entities.entity_bags(docs)

    def spy(texts):
        assert len(texts) <= entities.BATCH
        return entities.rule_entities(texts)

    assert [r["tokens"] for r in entities.entity_bags(docs, spy).orderBy("doc_id").collect()] == [["red_fox", f"blue_dog{i}"] for i in range(200)]
    assert bags.schema["doc_id"].dataType.simpleString() == "int" and "ArrowEvalPython" not in plan(bags) and "MapInArrow" in plan(bags)


def test_negation_counts_extracts_once(spark, tmp_path):
    """the vocabulary is read from written names; the extraction isn't run again for it."""
    rows = [(i, "No fever and red fox. No fever" + " or blue dog" * (i % 2)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    runs = spark.sparkContext.accumulator(0)
    old, entities.rule_entities = entities.rule_entities, lambda texts, extract=entities.rule_entities: (runs.add(len(texts)), extract(texts))[1]
    try:
        r = queries.QUERIES["negation_counts"](spark, str(tmp_path)).first()
    finally:
        entities.rule_entities = old
    assert runs.value == 20 and r["n_features"] > 0


def test_tfidf_equals_its_formula(spark):
    texts = ["aa bb aa", "aa cc", "bb cc dd", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    settings = tfidf.Settings(max_features=3, min_df=2, max_df=0.75)
    weighted, vocab = tfidf.tfidf(docs, settings)
    assert [r["feature_name"] for r in vocab.orderBy("feature_index").collect()] == ["aa", "bb", "cc"]
    raw = [(1 + math.log(2)) * (math.log(5 / 3) + 1), math.log(5 / 3) + 1]
    points = {r["row_id"]: r["x"] for r in tfidf.densify(docs, weighted, 3).collect()}
    assert points[0] == pytest.approx([raw[0] / math.hypot(*raw), raw[1] / math.hypot(*raw), 0]) and points[3] == [0, 0, 0]
    n = tfidf.negation_counts(spark.createDataFrame([(0, "neg_a"), (1, "NEG_b"), (2, "c")], "feature_index int, feature_name string")).first()
    assert (n["negated"], n["positive"]) == (2, 1)


def sparse_case(spark):
    """Texts with repeated words, none of the vocabulary, and a doc_id that two rows share."""
    texts = [(0, "aa bb aa cc"), (1, "aa cc"), (2, "bb cc dd"), (3, "zz"), (1, "aa bb")]
    return spark.createDataFrame(texts, "doc_id int, text string"), tfidf.Settings(max_features=3, min_df=2, max_df=0.9)


@pytest.mark.parametrize("together", [False, True])
def test_nonzero_histogram_builds_no_matrix(spark, together):
    """the counts are those of the dense matrix, without a shuffle where ids are unique."""
    docs, settings = sparse_case(spark)
    docs = docs if together else docs.where("text != 'aa bb'")
    terms, vocab, n = tfidf.features(docs, settings)
    counts = tfidf.nonzero_counts(terms, vocab)
    dense = tfidf.densify(docs.select("doc_id").distinct(), tfidf.weights(terms, vocab, n), 3)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, profile.nonzero_counts(dense).collect()))
    assert sorted(map(tuple, profile.histogram(counts, 3).collect())) == sorted(map(tuple, profile.nonzero_histogram(dense, 3).collect()))
    assert ("Exchange" in plan(counts)) == together


def test_sparsity_builds_no_matrix(spark):
    """F8"""
    docs, settings = sparse_case(spark)
    docs = docs.where("text != 'aa bb'")
    terms, vocab, n = tfidf.features(docs, settings)
    sparse = profile.sparse_sparsity(tfidf.nonzero_counts(terms, vocab), n, vocab.count()).first()
    assert sparse == profile.sparsity(tfidf.densify(docs, tfidf.weights(terms, vocab, n), vocab.count())).first()


def test_weights_shuffle_nothing(spark):
    """a document's terms are counted in its row; rows that share an id are one document."""
    docs, settings = sparse_case(spark)
    weighted, vocab = tfidf.tfidf(docs, settings)
    assert [(r["feature_name"], r["df"]) for r in vocab.orderBy("feature_index").collect()] == [("aa", 2), ("bb", 3), ("cc", 3)]
    w = [(1 + math.log(tf)) * (math.log(6 / (1 + df)) + 1) for tf, df in ((2, 2), (1, 3), (1, 3))]
    assert [r["w"] for r in weighted.where("doc_id = 1").orderBy("feature_index").collect()] == pytest.approx([v / math.hypot(*w) for v in w])
    assert "Exchange" not in plan(tfidf.tfidf(docs.where("text != 'aa bb'"), settings)[0])


def test_ngrams_in_batches_equal_the_expression(spark):
    """over parts of several documents, with short, empty and missing ones."""
    texts = ["a b c a b", "b", "", None, "c a b", " a  b "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for ngrams in ((2, 2), (1, 3)):
        settings = tfidf.Settings(analyzer="pieces", ngrams=ngrams)
        want = docs.select(F.explode(text.ngram_range(text.pieces(F.col("text")), *ngrams)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        counts = tfidf.ngram_counts(docs, settings)
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(r["t"] for r in tfidf.bags(docs, settings).select(F.explode("terms").alias("t")).collect()) == sorted(t for t, n in want.collect() for _ in range(n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_feature_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'")
    plain = text_features.plain(docs)
    n = plain.vocabulary.count()
    assert 0 < n <= 200 and plain.points.count() == plain.docs.count() and len(plain.points.first()["x"]) == n
    found = text_features.entity_based(docs, tfidf.Settings(50, 2, 0.85, "pieces", (1, 2), ()))
    assert found.points.count() == found.docs.count() > 0
    assert corpus.corpus_report(plain.points, plain.vocabulary)["features"] == n


def test_matrix_source(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text("1,2,3\n,4,5,6\n0.5abc,x,7\n8,9,10\n")
    points = files.read_matrix(spark, path, 3, 2, "compat")
    assert [list(r["x"]) for r in points.orderBy("row_id").collect()] == [[1, 2], [4, 5], [0.5, 0]]
    assert [list(r["x"]) for r in files.read_matrix(spark, path, 1, 3).collect()] == [[1, 2, 3]]
    for n, f in ((5, 2), (3, 4)):
        with pytest.raises(ValueError):
            files.read_matrix(spark, path, n, f, "compat")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        files.read_matrix(spark, path, 3, 2).collect()
    for bad in ({"source": "other"}, {"source": "csv"}):
        with pytest.raises(ValueError):
            files.load_points(spark, **bad)


def test_corpus_source(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,transcription,medical_specialty\n1,"two\nlines, ""quoted""",A\n2,,B\n')
    rows = files.read_corpus(spark, str(tmp_path / "c.csv")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["category"]) for r in rows] == [(0, 'two\nlines, "quoted"', "A"), (1, None, "B")]


def test_corpus_of_several_files(spark, tmp_path):
    """files go by name, whatever their sizes, and each is a task's."""
    sizes, n = [2, 40, 1, 9], 0
    for k, size in enumerate(sizes):
        (tmp_path / f"part-{k}.csv").write_text('"t","c"\n' + "".join(f'"{n + i}\nline, ""q""","A"\n' for i in range(size)))
        n += size
    docs = files.read_corpus(spark, str(tmp_path), "t", "c")
    assert docs.columns == ["doc_id", "text", "category"]
    assert [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()] == [(i, f'{i}\nline, "q"') for i in range(n)]


def test_corpus_is_written_by_several_tasks(spark, tmp_path):
    """no task of the round trip gets all documents."""
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = queries.QUERIES["corpus_csv"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(read.inputFiles()) > 1
    want = [r["text"] for r in queries.kept_docs(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert [(r["doc_id"], r["text"]) for r in read.orderBy("doc_id").collect()] == list(enumerate(want))


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_run_writes_its_results(spark, tmp_path):
    settings = clustering.RunSettings(n=60, features=8, clusters=2, max_iterations=6)
    report, table = clustering.run(spark, settings, str(tmp_path))
    assert report.first()["n_features"] == 8 and [r["strategy"] for r in table.collect()] == ["random", "kmeanspp", "domain"]
    u = lines(tmp_path / "membership_domain.csv")
    assert len(u) == 60 and all(abs(sum(map(float, x.split(","))) - 1) < 2e-6 and len(x.split(",")[0].split(".")[1]) == 6 for x in u)
    assert [len(x.split(",")) for x in lines(tmp_path / "centroids_random.csv")] == [8, 8]
    files.write_vocabulary(spark.createDataFrame([(1, "b"), (0, "a")], "feature_index int, feature_name string").coalesce(1), str(tmp_path / "v"))
    assert lines(tmp_path / "v") == ["feature_index,feature_name", "0,a", "1,b"]


def test_command_line():
    s, out = settings_from(["m.csv", "10", "3", "2", "--norm=zscore", "--no-idf", "--out", "o"])
    assert (s.source, s.n, s.features, s.clusters, s.norm, s.idf, out) == ("csv", 10, 3, 2, "zscore", False, "o")
    assert settings_from([])[0].norm == "l2"
    for bad in (["m.csv"], ["--norm=other"], ["m.csv", "0", "1", "1"], ["m.csv", "x", "1", "1"]):
        with pytest.raises(SystemExit):
            settings_from(bad)


def test_stream_gets_the_batch_memberships(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(20)], "row_id bigint, x array<double>")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    centroids = [[2.0, 1.0], [15.0, 1.0]]
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = write_assignments(stream, centroids, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["row_id"]: (r["u"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = fcm.membership(points, centroids).collect()
    assert len(got) == 20 and all(got[r["row_id"]][0] == pytest.approx(r["u"]) for r in batch)


def test_summary(spark):
    points = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "row_id bigint, x array<double>")
    s = fcm.summary(points, fcm.fit(points, init.Start("random", 3), max_iterations=3), 2)
    assert s["iterations"] <= 3 and sum(s["sizes"].values()) == 6 and set(s["sizes"]) == {0, 1, 2} and [i for i, _ in s["first"]] == [0, 1]
