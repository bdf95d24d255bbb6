"""The corpus pipeline: five of the operators, one after the other over the whole documents table.

Each stage takes what its predecessor kept, is written as Parquet in the shared folder and read again as the next
one's input. All but the last return the columns of documents (further columns of the input are kept as well); the
last adds token_ids, under a longer name where the input has one so named.

    quality    documents the classifier rejects go (and documents without text)
    dedup      one document of each near-duplicate group stays; repeated rows of a document are one
    secrets    texts that the ledger of scans lacks are scanned; secrets are replaced by [SECRET:rule]
    mix        rows are repeated or dropped so that the expected tokens meet TARGETS; no document that is clean first of all is dropped
    tokenize   byte-pair ids are added

Nulls, empty texts, ties, repeated rows, empty tables and clashing column names: as the operators' docstrings say. The
classifiers are fitted on the labelled documents that are left at their stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cumulo.llm import bpe, mixing, quality, secrets, simhash
from cumulo.session import read_table, remove, shared_dir

#: Shares of expected tokens after mixing; an input that is cleaner already keeps its share of clean.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}

#: A classifier and a tokenizer aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_docs(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def secret_ledger(spark: SparkSession) -> secrets.Store:
    """Kept in the shared folder for the session: a later run scans only the texts and rule versions that earlier ones haven't met."""
    return secrets.Store(spark, f"{shared_dir(spark)}/corpus-secret-ledger")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_scanned(docs, secret_ledger(spark))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(read_table(spark, sf_dir, "labels"))
    model = mixing.fit(docs, domains, len(mixing.DOMAINS))
    return mixing.mix(docs, model, [TARGETS[d] for d in mixing.DOMAINS], keep=mixing.DOMAINS.index("clean"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.add_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("dedup", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mix", mix_domains),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's files go when the next one has been written; those of the last stay in the shared folder, as the result reads them."""
    at, docs = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}", read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
        if i:
            remove(spark, f"{at}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
