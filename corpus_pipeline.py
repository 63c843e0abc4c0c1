"""A corpus from raw documents to tokens. STAGES are applied in order; each works on all that the one before kept.

Quality rules drop documents that fail them; of each group of near-duplicates one document stays; secrets are
replaced in the texts; documents are sampled to the raked mixture; the rest is encoded.

Defined results: a null or empty text fails the quality rules, so later stages see it only when called by themselves;
then it has no duplicates, no secrets, isn't sampled, and has no tokens. Rows without doc_id pass near_dedup, and are
drawn by their text in mixing. Of rows that repeat a doc_id, near_dedup keeps one. Each stage gives an empty table for
an empty one, and passes further columns on, whatever their names; the last returns its report instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import bpe, mixing, near_dedup, quality, secrets
from lexiquarry.llm._store import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, so n_chars is counted anew where it was right before."""
    model = secrets.train(secrets.labelled_strings(spark))
    clean = secrets.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_dedup", distinct),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: MinHash and BPE can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
