import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASHES = "keep string, shard string, rate string, score string, token_ids string, blob string, fp string, root string, tile string, label string, cumulo_p string, copies string, size string, key string"
LONG = "Ein langer Text mit vielen Wörtern, der sich nicht wiederholt: " + " ".join(f"wort{i}" for i in range(30_000))


def rows_with_edges():
    texts = ["The cat sat on the mat and looked out.", "The cat sat on the mat and looked out.", None, "", " \n\t ", LONG, "x", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" is here', "ünïcödé 漢字 🙂 e\u0301", "idiot moron scum stupid"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id at all here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows_with_edges(), COLUMNS)
    return df.select("*", *[F.lit(None if i % 2 else "extra").cast("string").alias(c.split()[0]) for i, c in enumerate(CLASHES.split(", "))])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 0, 0), (9, 1, 1), (None, 1, 0), (5, None, 1), (7, 1, None), (99, 0, 1), (0, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
