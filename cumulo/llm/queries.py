"""Registry of this subpackage's queries: name -> callable, name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.llm import bpe, chat, mixing, parsing, quality, secrets, sharding, simhash, topk, toxicity
from cumulo.session import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    domains = mixing.label_domains(read_table(spark, sf_dir, "labels"))
    model = mixing.fit(docs, domains, len(mixing.DOMAINS))
    return mixing.rates(docs, model, [mixing.TARGETS[d] for d in mixing.DOMAINS])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_copies(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one ledger: a first crawl of the English pages under the earlier rule versions, then the whole table under today's."""
    return secrets.report_in_two_scans(read_table(spark, sf_dir, "documents"), F.col("lang") == "en")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read_table(spark, sf_dir, "conversations"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.flagged(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "rank", F.col("neighbor").alias("neighbor_id"), F.round("score", 6).alias("score"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_format": op5_chat_format,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE_SQL = {
    "op3_sharding": sharding.oracle_sql(),
    "op4_secret_scan": secrets.oracle_sql(),
    "op5_chat_format": chat.ORACLE_SQL,
    "op9_exact_top_k": topk.ORACLE_SQL,
}
