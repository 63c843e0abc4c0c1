"""Cover addresses split into a base and a path, and put together again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def without_https(raw: Column) -> Column:
    """Stored covers lose a leading https:// before they are trimmed."""
    return F.when(F.startswith(raw, F.lit("https://")), F.substring(raw, 9, 2**31 - 1)).otherwise(raw)


def split_cover(raw: Column) -> Column:
    """Struct (base, path)."""
    trimmed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    s = F.when(F.startswith(trimmed, F.lit("//")), F.concat(F.lit("https:"), trimmed)).otherwise(trimmed)
    host = F.regexp_extract(s, _URL, 2)
    query = F.regexp_extract(s, _URL, 4)
    slash = F.instr(s, "/")
    pair = lambda base, path: F.struct(base.alias("base"), path.alias("path"))
    return (
        F.when(s == "", pair(F.lit(""), F.lit("")))
        .when(
            s.rlike("^https?://"),
            F.when(host == "", pair(F.lit(""), s)).otherwise(
                pair(
                    F.concat(F.regexp_extract(s, _URL, 1), F.lit("://"), host),
                    F.concat(F.regexp_extract(s, _URL, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")),
                )
            ),
        )
        .when(F.startswith(s, F.lit("/")), pair(F.lit(""), s))
        .when(F.contains(s, F.lit("://")), pair(F.lit(""), s))
        .when(slash == 0, pair(F.concat(F.lit("https://"), s), F.lit("")))
        .otherwise(
            pair(F.concat(F.lit("https://"), F.substring_index(s, "/", 1)), F.substring(s, slash, F.length(s)))
        )
    )
