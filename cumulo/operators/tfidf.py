"""TF-IDF over bags of tokens: (doc_id, terms) -> vocabulary -> (doc_id, feature_index, w), in long sparse form.

Tokens are found by built-in functions. They are counted in Arrow batches, a document's within its row, so that terms are shuffled but no document's are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.text import ngram_range, pieces, words

#: Documents counted at once.
ROWS = 256

#: Common English words; a parameter, as lists differ between libraries.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during
    each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or
    other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what
    when where which while who whom why will with would you your""".split()
)


@dataclass(frozen=True)
class Settings:
    """analyzer: words or pieces. max_df: share of documents. Both ends of the frequency limits are included."""

    max_features: int = 200
    min_df: int = 5
    max_df: float = 0.95
    analyzer: str = "words"
    ngrams: tuple[int, int] = (1, 1)
    stop_words: tuple[str, ...] = ()


PLAIN = Settings(200, 5, 0.95, "words", (1, 1), STOP_WORDS)
ENTITIES = Settings(500, 5, 0.85, "pieces", (1, 2), ())


def tokens(text: Column, settings: Settings) -> Column:
    """The tokens of a text in order, without stop words."""
    found = words(text) if settings.analyzer == "words" else pieces(text)
    if settings.stop_words:
        found = F.filter(found, lambda t: ~t.isin(*settings.stop_words))
    return found


def repeats(docs: DataFrame) -> tuple[int, bool]:
    """The number of rows, and whether any have the same doc_id."""
    r = docs.groupBy("doc_id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    return r["n"] or 0, (r["most"] or 0) > 1


def bags(docs: DataFrame, settings: Settings, together: bool | None = None) -> DataFrame:
    """(doc_id, terms): the tokens of each document, in order. Rows with the same doc_id are put together, which needs a shuffle; without such rows there is none."""
    split = docs.select("doc_id", tokens(F.col("text"), settings).alias("terms"))
    if settings.ngrams != (1, 1):
        split = split.mapInArrow(_with_ngrams(*settings.ngrams), f"{_id(docs)}, terms array<string>")
    if repeats(docs)[1] if together is None else together:
        return split.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return split


def _id(df: DataFrame, name: str = "doc_id") -> str:
    return f"{name} {df.schema['doc_id'].dataType.simpleString()}"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, terms, document of each term) of lists of terms, ROWS documents at a time."""
    for batch in batches:
        for s in range(0, len(batch), ROWS):
            part = batch.slice(s, ROWS)
            lists = part.column("terms")
            yield part.column("doc_id"), lists.flatten(), pc.list_parent_indices(lists).to_numpy()


def _joined(terms: pa.Array, of: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of n terms of one document, joined by one space, and their documents."""
    if n == 1:
        return terms, of
    whole = of[n - 1 :] == of[: len(of) - n + 1]
    ends = [terms.slice(i, max(0, len(terms) - n + 1)) for i in range(n)]
    return pc.binary_join_element_wise(*ends, pa.scalar(" ", terms.type)).filter(pa.array(whole)), of[: len(of) - n + 1][whole]


def _with_ngrams(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, terms, of in _parts(batches):
            found, places = zip(*[_joined(terms, of, n) for n in range(low, high + 1)])
            of = np.concatenate(places)
            order = pa.array(np.argsort(of, kind="stable"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found).take(order))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "terms"])

    return run


def ngram_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(term, n): the n-grams of all documents. The tokens are a projection of their own: inside the n-grams' loop the text would be split anew for each place."""
    split = docs.select(tokens(F.col("text"), settings).alias("tokens"))
    return split.select(F.explode(ngram_range(F.col("tokens"), *settings.ngrams)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def term_stats(terms: DataFrame, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(term, df, ctf) of bags: documents with the term, and its occurrences. Each part is counted before it leaves Python, so that only terms are shuffled.

    ngrams: of bags that have only tokens so far; formed here, they need no Python workers of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, of in _parts(batches if ngrams == (1, 1) else _with_ngrams(*ngrams)(batches)):
            coded = found.dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            df, ctf = np.bincount(np.unique(of * n + code) % n, minlength=n) if n else code, np.bincount(code, minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(ctf)], names=["term", "df", "ctf"])

    parts = terms.mapInArrow(run, "term string, df bigint, ctf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def vocabulary(terms: DataFrame, n_docs: int, settings: Settings, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(feature_index, feature_name, df): the most frequent terms within the limits (equal ones by name), numbered by name.

    It has at most max_features rows, which are fetched: what uses them doesn't read the documents again.
    """
    kept = term_stats(terms, ngrams).where((F.col("df") >= settings.min_df) & (F.col("df") <= F.lit(settings.max_df * n_docs)))
    top = kept.orderBy(F.desc("ctf"), "term").limit(settings.max_features).select("term", "df").orderBy("term").collect()
    rows = [(i, r["term"], r["df"]) for i, r in enumerate(top)]
    return terms.sparkSession.createDataFrame(rows, "feature_index int, feature_name string, df bigint")


def _entries(found: pa.Array, of: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, tf) of the terms that are among the names, by document."""
    code = pc.fill_null(pc.index_in(found, value_set=names), -1).to_numpy().astype(np.int64)
    n = max(1, len(names))
    keys, tf = np.unique(of[code >= 0] * n + code[code >= 0], return_counts=True)
    return keys // n, keys % n, tf


def weights(terms: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, feature_index, w) of bags: (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), each document to length 1. Nothing is shuffled."""
    known = vocab.orderBy("feature_index").collect()
    names, idf = [r["feature_name"] for r in known], np.array([np.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, of in _parts(batches):
            doc, feature, tf = _entries(found, of, pa.array(names, found.type))
            w = (1.0 + np.log(tf)) * idf[feature]
            length = np.sqrt(np.bincount(doc, w * w, minlength=len(ids)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(feature.astype(np.int32)), pa.array(w / length[doc])], names=["doc_id", "feature_index", "w"])

    return terms.mapInArrow(run, f"{_id(terms)}, feature_index int, w double")


def nonzero_counts(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, nnz) of bags: the vocabulary's terms that each document has, as weights are above 0. No matrix is built."""
    names = [r["feature_name"] for r in vocab.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, of in _parts(batches):
            doc, _, _ = _entries(found, of, pa.array(names, found.type))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(doc, minlength=len(ids)))], names=["row_id", "nnz"])

    return terms.mapInArrow(run, f"{_id(terms, 'row_id')}, nnz bigint")


def features(docs: DataFrame, settings: Settings = PLAIN) -> tuple[DataFrame, DataFrame, int]:
    """(bags, vocabulary, number) of docs(doc_id, text)."""
    n_docs, together = repeats(docs)
    terms = bags(docs, settings, together)
    if together:
        return terms, vocabulary(terms, n_docs, settings), n_docs
    split = docs.select("doc_id", tokens(F.col("text"), settings).alias("terms"))
    return terms, vocabulary(split, n_docs, settings, settings.ngrams), n_docs


def tfidf(docs: DataFrame, settings: Settings = PLAIN) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) of docs(doc_id, text)."""
    terms, vocab, n_docs = features(docs, settings)
    return weights(terms, vocab, n_docs), vocab


def densify(docs: DataFrame, weighted: DataFrame, n_features: int) -> DataFrame:
    """points(row_id, x): every document; one without a vocabulary term is a row of zeros."""
    entries = weighted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_index", "w"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    joined = docs.select("doc_id").join(entries, "doc_id", "left")
    zeros = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.lit(0.0))
    return joined.select(F.col("doc_id").cast("bigint").alias("row_id"), F.when(F.col("m").isNull(), zeros).otherwise(x).alias("x"))


def negation_counts(vocab: DataFrame) -> DataFrame:
    """One row: features, positive and negated ones and their percentages."""
    negated = F.lower("feature_name").startswith("neg_")
    n = F.count("*")
    return vocab.agg(
        n.alias("n_features"), F.count_if(~negated).alias("positive"), F.count_if(negated).alias("negated"),
        F.try_divide(F.lit(100.0) * F.count_if(~negated), n).alias("positive_pct"), F.try_divide(F.lit(100.0) * F.count_if(negated), n).alias("negated_pct"),
    )
