"""The catalogue: typed documents, dictionaries and the bigram index, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cover import split_cover
from ..functions.text import ASTRAL, SEPARATOR, bigrams, gram_key, gram_shard, indexable, norm, norm_each


@dataclass
class Catalog:
    docs: DataFrame
    tags: DataFrame
    authors: DataFrame
    postings: DataFrame
    grams: DataFrame
    #: Of a saved catalogue, the shards into which a hash deals grams; postings and grams then have a column `shard`.
    shards: int | None = None

    def cached(self) -> Catalog:
        """Every table persisted, so that searches don't derive them again."""
        for df in (self.docs, self.tags, self.authors, self.postings, self.grams):
            df.persist()
        return self

    def warm(self) -> Catalog:
        """cached(), and read now."""
        self.cached()
        for df in (self.docs, self.tags, self.authors, self.postings, self.grams):
            df.count()
        return self

    def release(self) -> None:
        for df in (self.docs, self.tags, self.authors, self.postings, self.grams):
            df.unpersist()


def tag_dictionary(entries: DataFrame) -> DataFrame:
    """(tag_id, name, count, bit): occurrences in all entries, first non-empty name, rank of tag_id."""
    each = entries.select("src_id", F.posexplode("tags").alias("pos", "t")).select("src_id", "pos", "t.tag_id", "t.name")
    named = F.when(F.coalesce("name", F.lit("")) != "", F.struct("src_id", "pos"))
    counted = each.groupBy("tag_id").agg(F.count("*").alias("count"), F.min_by("name", named).alias("first"))
    return counted.select(
        "tag_id",
        F.coalesce("first", F.col("tag_id").cast("string")).alias("name"),
        "count",
        (F.row_number().over(Window.orderBy("tag_id")) - 1).alias("bit"),
    )


def doc_authors(entries: DataFrame) -> DataFrame:
    """(id, src_id, pos, author_id, doc_name) of usable entries."""
    return entries.where("id is not null").select("id", "src_id", F.posexplode("authors").alias("pos", "a")).select(
        "id", "src_id", "pos", "a.author_id", F.col("a.name").alias("doc_name")
    )


def author_dictionary(entries: DataFrame) -> DataFrame:
    """(author_id, name): the first name in source order."""
    return doc_authors(entries).groupBy("author_id").agg(F.min_by("doc_name", F.struct("src_id", "pos")).alias("name"))


def documents(entries: DataFrame, authors: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One row per usable entry, with the normalised texts that boosts look at."""
    # A left join, so that only the dictionary may be broadcast, never the documents' side, however small its files are.
    known = authors.select("author_id", "name", F.lit(True).alias("known"))
    names = (
        doc_authors(entries)
        .join(known, "author_id", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", "name")))).alias("a"))
        .select("id", F.transform("a", lambda x: x["name"]).alias("author_names"))
    )
    cover = split_cover(F.col("cover"))
    base = entries.where("id is not null").join(names, "id", "left")
    authors_col = F.coalesce("author_names", F.array().cast("array<string>"))
    return base.select(
        "id",
        "title",
        cover["base"].alias("cover_base"),
        cover["path"].alias("cover_path"),
        "aliases",
        authors_col.alias("author_names"),
        F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["tag_id"]))).alias("tag_ids"),
        "hidden",
        "is_hide_chapter",
        "need_login",
        "is_lock",
        norm(F.col("title"), ascii_only).alias("title_norm"),
        norm(F.array_join("aliases", SEPARATOR), ascii_only).alias("aliases_norm"),
        norm(F.array_join(authors_col, SEPARATOR), ascii_only).alias("authors_norm"),
    )


def document_grams(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(id, grams, skipped): distinct grams of title, each alias and each author as the document names it."""
    texts = F.concat(F.array("title"), "aliases", F.transform("authors", lambda a: a["name"]))
    parts = entries.where("id is not null").select("id", norm_each(texts, ascii_only).alias("parts"))
    every = F.array_distinct(F.flatten(F.transform("parts", bigrams)))
    split = parts.select("id", every.alias("every"))
    return split.select("id", indexable(F.col("every")).alias("grams"), F.size(F.filter("every", lambda g: g.rlike(ASTRAL))).alias("skipped"))


def postings(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    return document_grams(entries, ascii_only).select(F.explode("grams").alias("gram"), "id")


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("gram").agg(F.count("*").alias("df"))


def check_ids(docs: DataFrame) -> None:
    """Raise ValueError unless ids are positive and none comes twice. Sorted by id, they then increase strictly."""
    bad = docs.groupBy("id").agg(F.count("*").alias("n")).where("id is null or id < 1 or n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"ids that aren't positive or come twice: {sorted((r['id'], r['n']) for r in bad)}")


def check_grams(grams: DataFrame) -> None:
    """Raise ValueError if two grams of the dictionary have one key."""
    twice = grams.groupBy(gram_key(F.col("gram")).alias("key")).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys that come twice: {sorted(r['key'] for r in twice)}")


def layout(posted: DataFrame, shards: int = 8) -> DataFrame:
    """(gram, shard, df, length, offset): where a gram's postings lie if each shard holds, in order of keys, the
    differences of ids (the first from -1) as numbers of seven bits to a byte.

    Only lengths by gram meet in a shard's running total; ids are counted before.
    """
    delta = F.col("id") - F.coalesce(F.lag("id").over(Window.partitionBy("gram").orderBy("id")), F.lit(-1))
    each = posted.select("gram", delta.alias("delta"))
    length = F.ceil(F.length(F.regexp_replace(F.bin("delta"), "^0+", "")) / 7).cast("long")
    sized = each.groupBy("gram").agg(F.count("*").alias("df"), F.sum(length).alias("length"))
    key = gram_key(F.col("gram"))
    placed = sized.select("*", key.alias("key"), gram_shard(key, shards).alias("shard"))
    before = Window.partitionBy("shard").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("gram", "shard", "df", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def build(entries: DataFrame, ascii_only: bool = False) -> Catalog:
    authors = author_dictionary(entries)
    posted = postings(entries, ascii_only)
    return Catalog(documents(entries, authors, ascii_only), tag_dictionary(entries), authors, posted, frequencies(posted))


def statistics(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One row: documents, tags, authors, distinct grams, postings, grams that can't be indexed."""
    grams = document_grams(entries, ascii_only)
    one = F.lit(1).alias("k")
    docs = grams.agg(F.count("*").alias("count"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped")).select(one, "*")
    posted = grams.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    posted = posted.agg(F.count("*").alias("unique_grams"), F.coalesce(F.sum("count"), F.lit(0)).alias("postings")).select(one, "*")
    tags = entries.select(F.explode("tags.tag_id").alias("t")).agg(F.count_distinct("t").alias("tags")).select(one, "*")
    authors = doc_authors(entries).agg(F.count_distinct("author_id").alias("authors")).select(one, "*")
    return docs.join(posted, "k").join(tags, "k").join(authors, "k").drop("k")
