"""Entries of the shape that json_documents gives, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _entry(tag_pairs, author_id, author, alias) -> list:
    tags = F.array(*[F.struct(i.cast("int").alias("tag_id"), n.cast("string").alias("name")) for i, n in tag_pairs])
    return [
        F.array(alias).alias("aliases"),
        F.array(F.struct(author_id.cast("int").alias("author_id"), author.alias("name"))).alias("authors"),
        tags.alias("tags"),
    ]


def _bit(number: str, k: int):
    return (F.floor(F.col(number) / 2**k).cast("long") % 2 == 1)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: name, brand as author, type as alias and tag, size as tag and flags."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.floor(F.col("p_size") / 10)
    # A type's tag id is 1000 and a number made from its characters.
    kind = 1000 + F.pmod(F.conv(F.substring(F.md5("p_type"), 1, 7), 16, 10).cast("long"), F.lit(100000))
    return p.select(
        (F.col("p_partkey") + 1).alias("src_id"),
        (F.col("p_partkey") + 1).alias("id"),
        F.col("p_name").alias("title"),
        F.lit("").alias("cover"),
        *_entry([(kind, F.col("p_type")), (size, F.concat(F.lit("size "), size.cast("string")))], F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"), F.col("p_brand"), F.col("p_type")),
        _bit("p_size", 0).alias("hidden"),
        _bit("p_size", 1).alias("is_hide_chapter"),
        _bit("p_size", 2).alias("need_login"),
        _bit("p_size", 3).alias("is_lock"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels: the whole text as title, source as author, language as alias and tag."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("title"), "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    joined = d.join(labels, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return joined.select(
        (F.col("doc_id") + 1).alias("src_id"),
        (F.col("doc_id") + 1).alias("id"),
        "title",
        F.lit("").alias("cover"),
        *_entry([(F.ascii("lang"), F.col("lang"))], F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.col("source"), F.col("lang")),
        flag("toxic").alias("hidden"),
        flag("quality").alias("is_hide_chapter"),
        F.lit(False).alias("need_login"),
        F.lit(False).alias("is_lock"),
    )
