"""The operators of this subpackage as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, html_templates, media_webp, mixing, near_dedup, quality, secrets, suffix_dedup, token_store
from ._store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_strings(spark))
    return secrets.secret_report(_table(spark, sf_dir, "documents"), model)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_webp.media_report(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_report(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.dialogues(_table(spark, sf_dir, "conversations"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_index(token_store.write_tokens(_table(spark, sf_dir, "documents"), new_path(spark, "tokens")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secrets,
        op2_media,
        op3_bpe,
        op4_html,
        op5_quality,
        op6_near_dedup,
        op7_suffix_dedup,
        op8_mixing,
        op9_chat,
        op10_token_store,
        pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.oracle(), "op8_mixing": mixing.oracle(), "op9_chat": chat.ORACLE}
