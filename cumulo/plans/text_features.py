"""From texts to feature matrices: plain TF-IDF, and TF-IDF over entity names with negation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.operators import corpus, entities, tfidf
from cumulo.operators.profile import check_range


@dataclass(frozen=True)
class Features:
    """docs: the documents that are left; points(row_id, x): a row for each; vocabulary(feature_index, feature_name, df)."""

    docs: DataFrame
    points: DataFrame
    vocabulary: DataFrame


def plain(docs: DataFrame, settings: tfidf.Settings = tfidf.PLAIN, least: int = corpus.MIN_CHARS) -> Features:
    """Documents of at least so many characters, by words."""
    kept = docs.where(corpus.long_enough(F.col("text"), least))
    weighted, vocab = tfidf.tfidf(kept, settings)
    return Features(kept, tfidf.densify(kept, weighted, max(1, vocab.count())), vocab)


def entity_based(docs: DataFrame, settings: tfidf.Settings = tfidf.ENTITIES, extract: entities.Extractor | None = None) -> Features:
    """Cleaned documents as bags of entity names, negated ones prefixed; documents without any name go.

    The bags are cached, as vocabulary, weights and matrix each read them. That also keeps the filter on their size from
    being pushed into the extraction, which would evaluate it again.
    """
    bags = entities.entity_bags(corpus.cleaned(docs), extract).persist()
    texts = entities.non_empty(bags).select("doc_id", F.array_join("tokens", " ").alias("text"))
    weighted, vocab = tfidf.tfidf(texts, settings)
    points = tfidf.densify(texts, weighted, max(1, vocab.count()))
    check_range(points)
    return Features(texts, points, vocab)
