"""Loosely typed JSON documents to typed entries.

Input: (id, json). Output, one row per document, also of those without a usable id, whose tags still count:

    src_id, id (null: skipped), title, cover, aliases, authors array<(author_id, name)>,
    tags array<(tag_id, name)> (names may be null), hidden, is_hide_chapter, need_login, is_lock
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cover import without_https


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_int(v: Column) -> Column:
    """Whole numbers; true and false count as 1 and 0."""
    return _kind(v).isin("BIGINT", "BOOLEAN")


def _string(v: Column, path: str) -> Column:
    part = _get(v, path, "variant")
    return F.when(_kind(part) == "STRING", _get(v, path, "string"))


def _lenient(v: Column, path: str) -> Column:
    """What reads as a whole number and isn't 0 (fractions of numbers are cut off); anything else is false.

    A text may have blanks around, a sign, and single underscores between its digits, which may be of any script.
    """
    kind, text = _kind(_get(v, path, "variant")), _get(v, path, "string")
    nonzero = text.rlike(r"^\s*[+-]?\p{Nd}+(_\p{Nd}+)*\s*$") & (F.regexp_replace(text, r"[\s+_0\uff10\u0660\u06f0\u0966-]", "") != "")
    number = F.abs(_get(v, path, "double")) >= 1
    found = F.when(kind == "BOOLEAN", _get(v, path, "boolean")).when(kind == "STRING", nonzero).when(kind != "VOID", number)
    return F.coalesce(found, F.lit(False))


def _entries(v: Column, path: str) -> Column:
    """Objects of an array whose tag_id is a whole number, as (number, name)."""
    items = F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    usable = F.filter(items, lambda x: _is_int(_get(x, "$.tag_id", "variant")))
    return F.transform(
        usable,
        lambda x: F.struct(
            _get(x, "$.tag_id", "long").alias("number"),
            F.when(_kind(_get(x, "$.tag_name", "variant")) == "STRING", _get(x, "$.tag_name", "string")).alias("name"),
        ),
    )


def _ranged(authors: Column, largest: int | None) -> Column:
    if largest is None:
        return authors
    wrong = F.exists(authors, lambda x: (x["number"] < 0) | (x["number"] > largest))
    return F.when(wrong, F.raise_error(F.lit(f"an author's id is not within 0 and {largest}"))).otherwise(authors)


def parse(raw: DataFrame, largest_author: int | None = None) -> DataFrame:
    """Entries of raw. An author's id below 0 or above largest_author, if given, fails the job, also where its name
    isn't usable."""
    v = F.col("v")
    rows = raw.select(F.col("id").cast("long").alias("src_id"), F.try_parse_json("json").alias("v"))
    can_read, kind = _get(v, "$.canRead", "variant"), _kind(_get(v, "$.canRead", "variant"))
    word = F.lower(F.trim(_get(v, "$.canRead", "string")))
    readable = (
        F.when(kind == "BOOLEAN", _get(v, "$.canRead", "boolean"))
        .when(kind == "STRING", F.when(word.isin("1", "true", "yes", "y"), True).when(word.isin("0", "false", "no", "n"), False))
        .when(can_read.isNotNull() & (kind != "VOID"), F.abs(_get(v, "$.canRead", "double")) >= 1)
    )
    hide = _get(v, "$.isHideChapter", "variant")
    strings = F.coalesce(_get(v, "$.aliases", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.filter(strings, lambda x: _kind(x) == "STRING")
    return rows.select(
        "src_id",
        F.when(_is_int(_get(v, "$.id", "variant")), _get(v, "$.id", "long")).alias("id"),
        F.coalesce(_string(v, "$.title"), F.lit("")).alias("title"),
        without_https(F.coalesce(_string(v, "$.cover"), F.lit(""))).alias("cover"),
        F.filter(F.transform(strings, lambda x: _get(x, "$", "string")), lambda s: s != "").alias("aliases"),
        F.transform(
            F.filter(_ranged(_entries(v, "$.authors"), largest_author), lambda x: F.coalesce(x["name"], F.lit("")) != ""),
            lambda x: F.struct(x["number"].try_cast("int").alias("author_id"), x["name"].alias("name")),
        ).alias("authors"),
        F.transform(_entries(v, "$.types"), lambda x: F.struct(x["number"].try_cast("int").alias("tag_id"), x["name"].alias("name"))).alias("tags"),
        _lenient(v, "$.hidden").alias("hidden"),
        ((_kind(hide) != "STRING") & F.coalesce(_get(v, "$.isHideChapter", "double") == 1, F.lit(False))).alias("is_hide_chapter"),
        F.coalesce(~readable, _lenient(v, "$.is_need_login")).alias("need_login"),
        _lenient(v, "$.is_lock").alias("is_lock"),
    )
