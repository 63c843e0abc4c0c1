"""Normalisation and character bigrams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Joins the entries of a list; normalisation deletes it.
SEPARATOR = "\x1f"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_NOT_WORD = r"[^\p{L}\p{N}]+"


@F.udf(T.StringType(), useArrow=True)
def _nfkc(text):
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column, ascii_only: bool = False) -> Column:
    """NFKC has no built-in function. Pass ascii_only for columns on which it changes nothing."""
    return text if ascii_only else _nfkc(text)


def strip(text: Column) -> Column:
    """Letters and numbers of a text, lower-cased."""
    return F.regexp_replace(F.lower(text), _NOT_WORD, "")


def norm(text: Column, ascii_only: bool = False) -> Column:
    return strip(nfkc(F.coalesce(text, F.lit("")), ascii_only))


def norm_each(texts: Column, ascii_only: bool = False) -> Column:
    """The entries of an array, normalised one by one; one pass of NFKC for all of them."""
    joined = nfkc(F.array_join(F.coalesce(texts, F.array().cast("array<string>")), SEPARATOR), ascii_only)
    return F.transform(F.split(joined, SEPARATOR), strip)


def bigrams(text: Column) -> Column:
    """All two-character substrings, in order. Characters are split once: substrings by place would each be looked
    for from the text's beginning."""
    chars = F.split(text, "")
    n = F.length(text)
    pairs = F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.concat(a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def indexable(grams: Column) -> Column:
    """The grams without characters beyond the basic plane, each once."""
    return F.array_distinct(F.filter(grams, lambda g: ~g.rlike(ASTRAL)))


def gram_key(gram: Column) -> Column:
    """A gram as one number of two 16-bit units."""
    return F.ascii(F.substring(gram, 1, 1)).cast("long") * 65536 + F.ascii(F.substring(gram, 2, 1)).cast("long")


def gram_shard(key: Column, shards: int) -> Column:
    """key * 2654435761 modulo 2^32, modulo shards, without overflow."""
    k, mask = F.lit(2654435761), F.lit(0xFFFFFFFF)
    high, low = F.shiftright(key, 16), key.bitwiseAND(F.lit(0xFFFF).cast("long"))
    product = F.shiftleft((high * k).bitwiseAND(mask), 16) + low * k
    return (product.bitwiseAND(mask) % shards).cast("int")


def norm_of(text: str) -> str:
    """norm() of one Python string."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def units(text: str) -> list[str]:
    """The UTF-16 units of text, lone surrogates as they are."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return [chr(int.from_bytes(raw[i : i + 2], "little")) for i in range(0, len(raw), 2)]


def request_grams(term: str) -> list[str]:
    """Distinct pairs of UTF-16 units: those with surrogates count, but are in no index."""
    u = units(term)
    return list(dict.fromkeys(a + b for a, b in zip(u, u[1:])))


def gram_key_of(gram: str) -> int:
    """gram_key() of one Python string."""
    return ord(gram[0]) * 65536 + ord(gram[1])


def gram_shard_of(key: int, shards: int) -> int:
    """gram_shard() of one number."""
    return key * 2654435761 % 2**32 % shards
