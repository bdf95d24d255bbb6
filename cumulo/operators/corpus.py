"""Filters and statistics of a text corpus docs(doc_id, text, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.text import clean, strip, truncate

MIN_CHARS, MIN_STRIPPED = 100, 50


def long_enough(text: Column, least: int = MIN_CHARS) -> Column:
    """Not null, and at least so many characters as they are."""
    return text.isNotNull() & (F.length(text) >= least)


def has_body(text: Column, more_than: int = MIN_STRIPPED) -> Column:
    """Not null, and more than so many characters between the outer white space."""
    return text.isNotNull() & (F.length(strip(text)) > more_than)


def filter_counts(docs: DataFrame) -> DataFrame:
    """One row, one pass: the rows, and those each filter drops from what is before it."""
    text = F.col("text")
    return docs.agg(
        F.count("*").alias("n_rows"),
        F.count_if(text.isNull()).alias("null_dropped"),
        F.count_if(text.isNotNull() & ~long_enough(text)).alias("short_dropped"),
        F.count_if(text.isNotNull() & ~has_body(text)).alias("body_dropped"),
        F.count_if(long_enough(text)).alias("long_kept"),
        F.count_if(has_body(text)).alias("body_kept"),
    )


def cleaned(docs: DataFrame, most: int = 2000) -> DataFrame:
    """docs with enough text, cleaned of numbers and white space and cut at so many characters."""
    return docs.where(has_body(F.col("text"))).withColumn("text", truncate(clean(F.col("text")), most))


def length_stats(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").agg(F.count("*").alias("n_docs"), F.avg(F.length("text")).alias("mean_chars"), F.min(F.length("text")).alias("min_chars"), F.max(F.length("text")).alias("max_chars"))


def category_count(docs: DataFrame, category: str = "category") -> DataFrame:
    return docs.agg(F.count_distinct(category).alias("n_categories"))


def top_categories(docs: DataFrame, k: int = 10, category: str = "category") -> DataFrame:
    """(category, n): the k largest; equal ones by name."""
    counts = docs.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(k)


def token_stats(bags: DataFrame) -> DataFrame:
    """One row of bags(doc_id, tokens): documents, those with tokens, their tokens, the mean number of those, and the negated ones."""
    n = F.size("tokens")
    negated = F.size(F.filter("tokens", lambda t: t.startswith("NEG_")))
    return bags.agg(
        F.count("*").alias("n_docs"), F.count_if(n > 0).alias("with_tokens"), F.sum(F.when(n > 0, n)).alias("n_tokens"), F.avg(F.when(n > 0, n)).alias("mean_tokens"), F.sum(F.when(n > 0, negated)).alias("n_negated")
    )


def corpus_report(points: DataFrame, vocabulary: DataFrame, k: int = 10) -> dict:
    """Rows, features, the first terms and the percentage of zeros of a feature matrix."""
    zeros = points.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("x", lambda v: v == 0))).alias("z"), F.sum(F.size("x")).alias("c")).first()
    terms = [r["feature_name"] for r in vocabulary.orderBy("feature_index").limit(k).collect()]
    return {"rows": zeros["n"], "features": vocabulary.count(), "first_terms": terms, "sparsity_pct": 100.0 * zeros["z"] / zeros["c"] if zeros["c"] else 0.0}
