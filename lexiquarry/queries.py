"""The engine's operators as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cover, text
from .operators import batch, index, search
from .plans.request import Request, parse
from .sources import catalogs, json_documents, store
from .sources.shared import shared_dir

# --- SQL common to the oracles ---------------------------------------------------------------------------

_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_GRAMS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, length({0}))])"

PARTS = f"""
d AS (
  SELECT p_partkey + 1 AS id, p_name AS title, p_brand AS author, regexp_extract(p_brand, '(\\d+)', 1)::INT AS author_id, p_type AS alias,
    (1000 + ('0x' || substr(md5(p_type), 1, 7))::BIGINT % 100000)::INT AS type_tag, (p_size // 10)::INT AS size_tag,
    p_size % 2 = 1 AS hidden, (p_size // 2) % 2 = 1 AS is_hide_chapter, (p_size // 4) % 2 = 1 AS need_login, (p_size // 8) % 2 = 1 AS is_lock,
    {_NORM.format("p_name")} AS title_norm, {_NORM.format("p_type")} AS aliases_norm, {_NORM.format("p_brand")} AS authors_norm
  FROM part),
"""
TEXTS = f"""
d AS (
  SELECT doc_id + 1 AS id, text AS title, source AS author, regexp_extract(source, '(\\d+)', 1)::INT AS author_id, lang AS alias,
    ascii(lang)::INT AS type_tag, ascii(lang)::INT AS size_tag,
    coalesce(toxic = 1, false) AS hidden, coalesce(quality = 1, false) AS is_hide_chapter, false AS need_login, false AS is_lock,
    {_NORM.format("text")} AS title_norm, {_NORM.format("lang")} AS aliases_norm, {_NORM.format("source")} AS authors_norm
  FROM documents LEFT JOIN labels USING (doc_id)),
"""
_POSTINGS = f"""
g AS (SELECT DISTINCT id, unnest({_GRAMS.format("t")}) AS gram FROM (
  SELECT id, title_norm AS t FROM d UNION ALL SELECT id, aliases_norm FROM d UNION ALL SELECT id, authors_norm FROM d))"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _passes_sql(r: Request) -> str:
    found = [f"(type_tag = {t} OR size_tag = {t})" for t in r.tags]
    found += [f"NOT (type_tag = {t} OR size_tag = {t})" for t in r.exclude_tags]
    for mode, column in search.FLAGS:
        if (wanted := getattr(r, mode)) != "any":
            found.append(column if wanted == "only1" else f"NOT {column}")
    return " AND ".join(found) or "true"


def _matches_sql(r: Request, source: str) -> str:
    """CTEs that end in found(id, score)."""
    include, exclude = parse(r.q)
    out = [source.strip().rstrip(","), _POSTINGS.strip()]
    for name, terms in (("i", include), ("x", exclude)):
        for k, t in enumerate(terms):
            grams = ", ".join(map(_quote, t.grams))
            out.append(f"f_{name}{k} AS (SELECT count(DISTINCT gram) AS f FROM g WHERE gram IN ({grams}))")
            out.append(
                f"m_{name}{k} AS (SELECT id, count(*) AS hit FROM g WHERE gram IN ({grams}) GROUP BY id "
                f"HAVING count(*) >= (SELECT least(greatest(1, ceil({t.n} * 0.6)), f) FROM f_{name}{k}))"
            )
    score, wanted = "0.0::DOUBLE", _passes_sql(r)
    joins = " ".join(f"LEFT JOIN m_i{k} USING (id)" for k in range(len(include)))
    if include:
        wanted += " AND (" + " OR ".join(f"m_i{k}.hit IS NOT NULL" for k in range(len(include))) + ")"
        parts = [f"coalesce(m_i{k}.hit, 0)::DOUBLE / {t.n}" for k, t in enumerate(include)]
        if len(include) > 1 and r.sort != "relevance":
            score = "1.0::DOUBLE"
        else:
            score = parts[0]
            if len(include) > 1:
                score = "0.0::DOUBLE"
                for p in parts:
                    score = f"(({score} + {p})::FLOAT)::DOUBLE"
            for t in include:
                for column, boost in search.BOOSTS:
                    score = f"{score} + CASE WHEN contains({column}, {_quote(t.text)}) THEN {boost}::DOUBLE ELSE 0.0::DOUBLE END"
            score = f"(({score})::FLOAT)::DOUBLE"
    elif not exclude and not r.filtered:
        wanted = "false"
    for k in range(len(exclude)):
        wanted += f" AND id NOT IN (SELECT id FROM m_x{k})"
    out.append(f"found AS (SELECT id, {score} AS score FROM d {joins} WHERE {wanted})")
    return ",\n".join(out)


def _order_sql(r: Request) -> str:
    if r.sort == "id_asc":
        return "id"
    return "score DESC, id DESC" if r.sort == "relevance" and parse(r.q)[0] else "id DESC"


def _page_sql(r: Request, source: str = PARTS, columns: str = "rank, id, score, total, has_more", joins: str = "") -> str:
    return f"""WITH {_matches_sql(r, source)},
ranked AS (SELECT row_number() OVER (ORDER BY {_order_sql(r)}) AS rank, id, score, count(*) OVER () AS total FROM found),
page AS (SELECT *, {r.offset + r.limit} < total AS has_more FROM ranked WHERE rank > {r.offset} AND rank <= {r.offset + r.limit})
SELECT {columns} FROM page {joins}"""


# --- catalogues ------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.parts(spark, sf_dir)


def _part_catalog(spark: SparkSession, sf_dir: str) -> index.Catalog:
    return index.build(_parts(spark, sf_dir), ascii_only=True)


def _text_catalog(spark: SparkSession, sf_dir: str) -> index.Catalog:
    return index.build(catalogs.texts(spark, sf_dir))


FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(name: str, sql: str):
    def keep(f):
        FOUND[name] = (f, sql)
        return f

    return keep


def _search_query(name: str, r: Request, catalog=_part_catalog, source: str = PARTS) -> None:
    def run(spark, sf_dir):
        built = catalog(spark, sf_dir).cached()  # read several times; what doesn't fit in memory goes to disk
        try:
            return search.search(built, r)
        finally:
            built.release()

    FOUND[name] = (run, _page_sql(r, source))


# --- scalar functions ------------------------------------------------------------------------------------


@_query("norm_text", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.norm(F.col("text")).alias("norm"))


def _names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.norm(F.col("p_name"), True).alias("t"))


_T = f"(SELECT p_partkey, {_NORM.format('p_name')} AS t FROM part)"


@_query("bigrams", f"SELECT p_partkey, i - 1 AS pos, substr(t, i, 2) AS gram FROM (SELECT *, unnest(range(1, length(t))) AS i FROM {_T})")
def bigrams(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.posexplode(text.bigrams(F.col("t"))).alias("pos", "gram"))


@_query("bigrams_distinct", f"SELECT p_partkey, unnest({_GRAMS.format('t')}) AS gram FROM {_T}")
def bigrams_distinct(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.explode(F.array_distinct(text.bigrams(F.col("t")))).alias("gram"))


_TEXT_GRAMS = f"SELECT DISTINCT unnest({_GRAMS.format('t')}) AS gram FROM (SELECT {_NORM.format('text')} AS t FROM documents)"
_KEY = "(unicode(gram)::BIGINT * 65536 + unicode(substr(gram, 2, 1)))"


def _text_grams(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(text.norm(F.col("text")).alias("t"))
    return d.select(F.explode(text.indexable(text.bigrams(F.col("t")))).alias("gram")).distinct()


@_query("gram_key", f"SELECT gram, {_KEY} AS key FROM ({_TEXT_GRAMS})")
def gram_key(spark, sf_dir):
    return _text_grams(spark, sf_dir).select("gram", text.gram_key(F.col("gram")).alias("key"))


@_query("gram_shard", f"SELECT gram, (({_KEY}::HUGEINT * 2654435761) % 4294967296 % 8)::INT AS shard FROM ({_TEXT_GRAMS})")
def gram_shard(spark, sf_dir):
    return _text_grams(spark, sf_dir).select("gram", text.gram_shard(text.gram_key(F.col("gram")), 8).alias("shard"))


_SPLIT = r"""SELECT page_id, CASE WHEN s LIKE 'https://%' OR s LIKE 'http://%' THEN regexp_extract(s, '^(https?://[^/?#]+)', 1)
  WHEN s LIKE '/%' OR s LIKE '%://%' OR s = '' THEN '' ELSE 'https://' || split_part(s, '/', 1) END AS base,
  CASE WHEN s LIKE 'https://%' OR s LIKE 'http://%' THEN regexp_extract(s, '^https?://[^/?#]+([^#]*)', 1)
  WHEN s LIKE '/%' OR s LIKE '%://%' THEN s WHEN contains(s, '/') THEN substr(s, instr(s, '/')) ELSE '' END AS path
FROM (SELECT page_id, CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE url END AS s FROM pages)"""


@_query("cover_split", _SPLIT)
def cover_split(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", cover.split_cover(cover.without_https(F.col("url"))).alias("c")).select("page_id", "c.base", "c.path")


@_query("cover_joined", f"SELECT page_id, base || path AS cover FROM ({_SPLIT})")
def cover_joined(spark, sf_dir):
    return cover_split(spark, sf_dir).select("page_id", F.concat("base", "path").alias("cover"))


@_query("cover_base_dictionary", f"SELECT base, (row_number() OVER (ORDER BY min(page_id)))::BIGINT AS number FROM ({_SPLIT}) WHERE base <> '' GROUP BY base")
def cover_base_dictionary(spark, sf_dir):
    bases = cover_split(spark, sf_dir).where("base <> ''").groupBy("base").agg(F.min("page_id").alias("first"))
    return bases.select("base", F.row_number().over(Window.orderBy("first")).cast("long").alias("number"))


@_query("flags_pack", f"WITH {PARTS.strip().rstrip(',')} SELECT id, hidden::INT + 2 * is_hide_chapter::INT + 4 * need_login::INT + 8 * is_lock::INT AS flags FROM d")
def flags_pack(spark, sf_dir):
    bit = lambda c, k: F.col(c).cast("int") * k
    return _parts(spark, sf_dir).select("id", (bit("hidden", 1) + bit("is_hide_chapter", 2) + bit("need_login", 4) + bit("is_lock", 8)).alias("flags"))


@_query("shard_assignment", "SELECT id, number // 4096 AS shard, number % 4096 AS place FROM (SELECT p_partkey + 1 AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part)")
def shard_assignment(spark, sf_dir):
    """Documents numbered in order of ids without one ordered task for all: counts by range first."""
    ids = _parts(spark, sf_dir).select("id", F.floor(F.col("id") / 4096).alias("range"))
    before = ids.groupBy("range").count()
    start = before.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    n = ids.withColumn("k", within).join(start, "range").select("id", (F.col("start") + F.col("k")).alias("number"))
    return n.select("id", F.floor(F.col("number") / 4096).alias("shard"), (F.col("number") % 4096).alias("place"))


# --- dictionaries and index ------------------------------------------------------------------------------

_INDEX = f"WITH {PARTS.strip()}\n{_POSTINGS.strip()}\n"


@_query("postings", _INDEX + "SELECT gram, id FROM g")
def postings(spark, sf_dir):
    return index.postings(_parts(spark, sf_dir), True)


@_query("postings_text", f"WITH {TEXTS.strip()}\n{_POSTINGS.strip()}\nSELECT gram, id FROM g")
def postings_text(spark, sf_dir):
    return index.postings(catalogs.texts(spark, sf_dir))


@_query("gram_df", _INDEX + "SELECT gram, count(*) AS df FROM g GROUP BY gram")
def gram_df(spark, sf_dir):
    return index.frequencies(index.postings(_parts(spark, sf_dir), True))


@_query("posting_delta", _INDEX + "SELECT gram, id, id - coalesce(lag(id) OVER (PARTITION BY gram ORDER BY id), -1) AS delta FROM g")
def posting_delta(spark, sf_dir):
    before = F.coalesce(F.lag("id").over(Window.partitionBy("gram").orderBy("id")), F.lit(-1))
    return postings(spark, sf_dir).select("gram", "id", (F.col("id") - before).alias("delta"))


@_query(
    "index_stats",
    _INDEX + "SELECT (SELECT count(*) FROM d) AS count, 0::BIGINT AS skipped, count(DISTINCT gram) AS unique_grams, count(*) AS postings, "
    "(SELECT count(DISTINCT t) FROM (SELECT type_tag AS t FROM d UNION ALL SELECT size_tag FROM d)) AS tags, "
    "(SELECT count(DISTINCT author_id) FROM d) AS authors FROM g",
)
def index_stats(spark, sf_dir):
    return index.statistics(_parts(spark, sf_dir), True)


_TAGS = """t AS (SELECT id, 0 AS pos, type_tag AS tag_id, alias AS name FROM d UNION ALL SELECT id, 1, size_tag, 'size ' || size_tag FROM d)"""


@_query(
    "tag_dictionary",
    f"WITH {PARTS.strip()} {_TAGS} SELECT tag_id, arg_min(name, id * 2 + pos) AS name, count(*) AS count, (row_number() OVER (ORDER BY tag_id) - 1)::INT AS bit FROM t GROUP BY tag_id",
)
def tag_dictionary(spark, sf_dir):
    return index.tag_dictionary(_parts(spark, sf_dir))


@_query(
    "tags_published",
    f"WITH {PARTS.strip()} {_TAGS} SELECT row_number() OVER (ORDER BY count(*) DESC, arg_min(name, id * 2 + pos), tag_id) AS place, tag_id FROM t GROUP BY tag_id",
)
def tags_published(spark, sf_dir):
    place = F.row_number().over(Window.orderBy(F.desc("count"), "name", "tag_id")).cast("long")
    return tag_dictionary(spark, sf_dir).select(place.alias("place"), "tag_id")


@_query("author_dictionary", f"WITH {PARTS.strip().rstrip(',')} SELECT author_id, arg_min(author, id) AS name FROM d GROUP BY author_id")
def author_dictionary(spark, sf_dir):
    return index.author_dictionary(_parts(spark, sf_dir))


@_query("doc_tags", f"WITH {PARTS.strip()} {_TAGS} SELECT DISTINCT id, tag_id, name FROM t")
def doc_tags(spark, sf_dir):
    entries = _parts(spark, sf_dir)
    each = entries.select("id", F.explode("tags.tag_id").alias("tag_id")).distinct()
    return each.join(index.tag_dictionary(entries).select("tag_id", "name"), "tag_id").select("id", "tag_id", "name")


@_query("doc_authors", f"WITH {PARTS.strip().rstrip(',')} SELECT id, 0 AS pos, author_id, author AS doc_name FROM d")
def doc_authors(spark, sf_dir):
    return index.doc_authors(_parts(spark, sf_dir)).drop("src_id")


@_query(
    "tag_bitset",
    f"WITH {PARTS.strip()} {_TAGS}, b AS (SELECT tag_id, row_number() OVER (ORDER BY tag_id) - 1 AS bit FROM t GROUP BY tag_id) "
    "SELECT id, bit // 32 AS word, bit_or(1::BIGINT << (bit % 32)::INT) AS bits FROM (SELECT DISTINCT id, tag_id FROM t) JOIN b USING (tag_id) GROUP BY id, bit // 32",
)
def tag_bitset(spark, sf_dir):
    entries = _parts(spark, sf_dir)
    each = entries.select("id", F.explode("tags.tag_id").alias("tag_id")).distinct()
    bits = each.join(index.tag_dictionary(entries).select("tag_id", "bit"), "tag_id")
    word = F.floor(F.col("bit") / 32).alias("word")
    return bits.groupBy("id", word).agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits"))


# --- filters ---------------------------------------------------------------------------------------------


def _filter_query(name: str, r: Request) -> None:
    def run(spark, sf_dir):
        return _part_catalog(spark, sf_dir).docs.where(search.passes(r)).select("id")

    FOUND[name] = (run, f"WITH {PARTS.strip().rstrip(',')} SELECT id FROM d WHERE {_passes_sql(r)}")


_filter_query("filter_tags_all", Request(tags=(3,)))
_filter_query("filter_tags_none", Request(exclude_tags=(0, 4)))
_filter_query("filter_tags_both", Request(tags=(2,), exclude_tags=(3,)))
_filter_query("filter_hidden_only0", Request(hidden="only0"))
_filter_query("filter_hidden_only1", Request(hidden="only1"))
_filter_query("filter_hide_chapter", Request(hide_chapter="only1"))
_filter_query("filter_need_login", Request(need_login="only0"))
_filter_query("filter_lock", Request(lock="only1"))
_filter_query("filter_combined", Request(tags=(1,), hidden="only0", need_login="only1", lock="any"))

# --- search ----------------------------------------------------------------------------------------------

_ONE = Request(q="brand#13")


@_query(
    "hit_count",
    _INDEX + f"SELECT id, count(*) AS h0 FROM g WHERE gram IN ({', '.join(map(_quote, parse(_ONE.q)[0][0].grams))}) GROUP BY id "
    f"HAVING count(*) >= least(4, (SELECT count(DISTINCT gram) FROM g WHERE gram IN ({', '.join(map(_quote, parse(_ONE.q)[0][0].grams))})))",
)
def hit_count(spark, sf_dir):
    catalog, (terms, _) = _part_catalog(spark, sf_dir), parse(_ONE.q)
    found = search.hits(catalog, terms, search.known_grams(catalog, terms))
    return found if found is not None else catalog.docs.limit(0).select("id", F.lit(0).cast("long").alias("h0"))


_WORDS = ("widget", "rdring", "brand#11", "zzqq", "steel", "a1b2")
_N = ", ".join(f"({_quote(w)}, {json.dumps([g for g in parse(w)[0][0].grams]).replace(chr(34), chr(39))})" for w in _WORDS)


@_query(
    "term_threshold",
    _INDEX + f", w(term, grams) AS (VALUES {_N}), u AS (SELECT term, unnest(grams) AS gram FROM w), "
    "c AS (SELECT term, count(*) AS n, count(k.gram) AS f FROM u LEFT JOIN (SELECT DISTINCT gram FROM g) k USING (gram) GROUP BY term) "
    "SELECT term, n::INT AS n, f::INT AS f, least(greatest(1, ceil(n * 0.6)), f)::INT AS least FROM c",
)
def term_threshold(spark, sf_dir):
    rows = [(w, t.n, g) for w in _WORDS for t in parse(w)[0] for g in t.grams]
    grams = spark.createDataFrame(rows, "term string, n int, gram string")
    counted = F.broadcast(grams).join(index.frequencies(postings(spark, sf_dir)), "gram", "left")
    each = grams.join(counted.select("term", "gram", "df"), ["term", "gram"]).groupBy("term", "n").agg(F.count("df").cast("int").alias("f"))
    return each.select("term", "n", "f", F.least(F.greatest(F.lit(1), F.floor((3 * F.col("n") + 4) / 5).cast("int")), F.col("f")).alias("least"))


_search_query("search_single", Request(q="brand#13"))
_search_query("search_single_typo", Request(q="brnad#23", size=100))
_search_query("search_single_id_asc", Request(q="brand#13", sort="id_asc"))
_search_query("search_single_id_desc", Request(q="brand#13", sort="id_desc"))
_search_query("search_multi_or", Request(q="small brand#22 widgt", size=100))
_search_query("search_multi_id_asc", Request(q="brand#11 ring", sort="id_asc"))
_search_query("search_multi_id_desc", Request(q="brand#11 ring", sort="id_desc"))
_search_query("search_unknown_term_in_multi", Request(q="brand#11 zzqq"))
_search_query("search_no_match", Request(q="qqzzxx"))
_search_query("search_text", Request(q="tion queeau", size=50), _text_catalog, TEXTS)
_search_query("search_text_single", Request(q="èment", size=50), _text_catalog, TEXTS)
_search_query("search_text_exclude", Request(q="thing -fr", size=50), _text_catalog, TEXTS)
_search_query("exclude_only", Request(q="-ring"))
_search_query("exclude_unknown_only", Request(q="-zzqqxx"))
_search_query("include_exclude", Request(q="brand#2 -ring", size=50))
_search_query("include_cancelled_by_exclude", Request(q="ring -ring"))
_search_query("full_width_sign", Request(q="\uff0dring"))
_search_query("search_with_filters", Request(q="brand#13 ring", tags=(2,), exclude_tags=(3,), hidden="only0"))
_search_query("filter_scan", Request(tags=(2,), lock="only1"))
_search_query("page_2", Request(q="brand#13", page=2))
_search_query("page_past_end", Request(q="brand#13", page=99999))
_search_query("size_clamp", Request(q="brand#13", size=1000))
_search_query("size_low", Request(q="brand#13", size=-1))
_search_query("by_author", Request(q="Brand#31"))
_search_query("by_tag", Request(tags=(4,)))
_search_query("empty_request", Request())
_search_query("short_term", Request(q="a"))


@_query("result_total_has_more", _page_sql(Request(q="brand#13", size=7), columns="DISTINCT total, has_more"))
def result_total_has_more(spark, sf_dir):
    return search.search(_part_catalog(spark, sf_dir), Request(q="brand#13", size=7)).select("total", "has_more").distinct()


_ITEM = Request(q="brand#13", tags=(2,), size=30)


@_query(
    "hydrate_page",
    _page_sql(
        _ITEM,
        columns="rank, id, title, author, alias, (CASE WHEN type_tag < size_tag THEN type_tag || ':' || alias || ',' || size_tag || ':size ' || size_tag "
        "ELSE size_tag || ':size ' || size_tag || ',' || type_tag || ':' || alias END) AS tags, hidden, is_hide_chapter, need_login, is_lock, total, has_more",
        joins="JOIN d USING (id)",
    ),
)
def hydrate_page(spark, sf_dir):
    catalog = _part_catalog(spark, sf_dir)
    items = search.hydrate(catalog, search.search(catalog, _ITEM))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["tag_id"].cast("string"), F.lit(":"), t["name"])), ",")
    names = [F.array_join("authors", "/").alias("author"), F.array_join("aliases", "/").alias("alias"), tags.alias("tags")]
    return items.select("rank", "id", "title", *names, "hidden", "is_hide_chapter", "need_login", "is_lock", "total", "has_more")


#: Requests of all kinds: terms, terms to exclude, filters alone, sorts and pages.
_MANY = {
    1: Request(q="brand#13"),
    2: Request(q="small ring -brand#2"),
    3: Request(q="widgt brand#11 steel"),
    4: Request(q="zzqq"),
    5: Request(q="-ring"),
    6: Request(q="bolt"),
    7: Request(q="brand#13 ring", tags=(2,), exclude_tags=(3,), hidden="only0"),
    8: Request(q="brand#11 ring", sort="id_asc", page=2, size=7),
    9: Request(tags=(2,), lock="only1", sort="id_asc"),
    10: Request(q="-ring", hidden="only1", page=2),
    11: Request(),
    12: Request(q="brand#13", sort="id_desc", need_login="only1", size=1000),
}


def _requests(spark: SparkSession) -> DataFrame:
    fields = ("q", "tags", "exclude_tags", "hidden", "hide_chapter", "need_login", "lock", "sort", "page", "size")
    rows = [(k, *[list(v) if isinstance(v := getattr(r, f), tuple) else v for f in fields]) for k, r in _MANY.items()]
    flags = "hidden string, hide_chapter string, need_login string, lock string"
    return spark.createDataFrame(rows, f"request_id long, q string, tags array<int>, exclude_tags array<int>, {flags}, sort string, page int, size int")


def _many_sql() -> str:
    return " UNION ALL ".join(f"SELECT {k}::BIGINT AS request_id, * FROM ({_page_sql(r)})" for k, r in _MANY.items())


@_query("batch_search", _many_sql())
def batch_search(spark, sf_dir):
    return batch.search_many(_part_catalog(spark, sf_dir), _requests(spark))


@_query(
    "item_details",
    _page_sql(
        _ITEM,
        columns="rank, id, 'item/' || id AS href, title, alias AS alias_text, concat_ws(',', CASE WHEN hidden THEN 'hidden' END, "
        "CASE WHEN is_hide_chapter THEN 'chapters hidden' END, CASE WHEN need_login THEN 'login needed' END, CASE WHEN is_lock THEN 'locked' END) AS status",
        joins="JOIN d USING (id)",
    ),
)
def item_details(spark, sf_dir):
    catalog = _part_catalog(spark, sf_dir)
    shown = search.details(search.hydrate(catalog, search.search(catalog, _ITEM)), "item/")
    return shown.withColumn("status", F.array_join("status", ","))


@_query("resolved_tags", f"WITH {PARTS.strip().rstrip(',')} SELECT id FROM d WHERE (type_tag = 2 OR size_tag = 2) AND NOT (type_tag = 3 OR size_tag = 3)")
def resolved_tags(spark, sf_dir):
    """Tags chosen by name and id: the unknown one goes, and 2 is chosen although it is excluded too."""
    catalog = _part_catalog(spark, sf_dir)
    r = search.Searcher(catalog).choose(("size 2", "no such tag"), (3, 2, -7))
    return catalog.docs.where(search.passes(r)).select("id")


# --- the saved catalogue -----------------------------------------------------------------------------------

_BYTES = "ceil((floor(log2(delta)) + 1) / 7)::BIGINT"


@_query(
    "posting_layout",
    _INDEX + f", e AS (SELECT gram, id - coalesce(lag(id) OVER (PARTITION BY gram ORDER BY id), -1) AS delta FROM g), "
    f"l AS (SELECT gram, {_KEY} AS key, count(*) AS df, sum({_BYTES})::BIGINT AS length FROM e GROUP BY gram), "
    "s AS (SELECT *, ((key::HUGEINT * 2654435761) % 4294967296 % 8)::INT AS shard FROM l) "
    "SELECT gram, shard, df, length, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM s",
)
def posting_layout(spark, sf_dir):
    return index.layout(postings(spark, sf_dir), 8)


def _saved(spark: SparkSession, sf_dir: str, name: str) -> index.Catalog:
    folder = f"{shared_dir(spark)}/catalogue-{name}-{uuid.uuid4().hex[:8]}"
    store.save(_part_catalog(spark, sf_dir), folder, shards=8, generated_at="2026-01-01T00:00:00Z", skipped=0)
    return store.load(spark, folder)


@_query("saved_search", _page_sql(Request(q="brand#13 ring -bolt", size=30)))
def saved_search(spark, sf_dir):
    """Written, read by its manifest, and probed by the grams' shards."""
    return search.search(_saved(spark, sf_dir, "search"), Request(q="brand#13 ring -bolt", size=30))


@_query(
    "saved_statistics",
    _INDEX + "SELECT (SELECT count(*) FROM d) AS count, count(DISTINCT gram) AS unique_grams, count(*) AS postings, "
    "(SELECT count(DISTINCT t) FROM (SELECT type_tag AS t FROM d UNION ALL SELECT size_tag FROM d)) AS tags, "
    "(SELECT count(DISTINCT author_id) FROM d) AS authors, 8 AS shards, '2026-01-01T00:00:00Z' AS generated_at FROM g",
)
def saved_statistics(spark, sf_dir):
    """What the manifest of a saved catalogue says of it."""
    folder = f"{shared_dir(spark)}/catalogue-statistics-{uuid.uuid4().hex[:8]}"
    store.save(_part_catalog(spark, sf_dir), folder, shards=8, generated_at="2026-01-01T00:00:00Z", skipped=0)
    m = store.get_json(spark, f"{folder}/manifest.json")
    kept = ("count", "unique_grams", "postings", "tags", "authors")
    schema = ", ".join(f"{k} long" for k in kept) + ", shards int, generated_at string"
    return spark.createDataFrame([(*[m["stats"][k] for k in kept], m["shards"], m["generated_at"])], schema)


@_query("saved_postings", _INDEX + "SELECT gram, id, ((" + _KEY + "::HUGEINT * 2654435761) % 4294967296 % 8)::INT AS shard FROM g")
def saved_postings(spark, sf_dir):
    return _saved(spark, sf_dir, "postings").postings.select("gram", "id", "shard")


@_query(
    "saved_documents",
    f"WITH {PARTS.strip().rstrip(',')} SELECT id, title, alias, author, hidden, is_hide_chapter, need_login, is_lock, title_norm, aliases_norm, authors_norm FROM d",
)
def saved_documents(spark, sf_dir):
    docs = _saved(spark, sf_dir, "documents").docs
    names = [F.array_join("aliases", "/").alias("alias"), F.array_join("author_names", "/").alias("author")]
    return docs.select("id", "title", *names, "hidden", "is_hide_chapter", "need_login", "is_lock", "title_norm", "aliases_norm", "authors_norm")


# --- ingest ----------------------------------------------------------------------------------------------

#: Dirty documents and what becomes of them: id, title, cover base and path, flags.
DIRTY = (
    (1, '{"id":11,"title":"Red Ring","cover":"https://h/p.png#f","authors":[{"tag_id":5,"tag_name":"Ann Lee"}],"aliases":["Rr",""],"types":[{"tag_id":7,"tag_name":"a"}],"hidden":0}'),
    (2, '{"id":"12","title":"Bad id","types":[{"tag_id":7,"tag_name":"b"}]}'),
    (3, '{"id":13,"authors":[{"tag_id":5,"tag_name":"A. Lee"},{"tag_id":"6","tag_name":"x"}],"types":[{"tag_id":7},{"tag_id":7}]}'),
    (4, '{"id":14,"title":"T","hidden":"1","isHideChapter":"1","canRead":"no","is_need_login":0,"is_lock":true}'),
    (5, '{"id":15,"title":"T","hidden":"x","isHideChapter":1.0,"canRead":"maybe","is_need_login":2}'),
    (6, '{"id":16,"title":"T","canRead":true,"is_need_login":1}'),
    (7, '{"id":17,"title":"T","canRead":0.5,"hidden":"1_0","is_lock":99999999999}'),
    (8, '{"id":18,"title":"T","hidden":0.9,"is_lock":"１","canRead":-3}'),
)


@_query(
    "ingest_json",
    """SELECT * FROM (VALUES (11::BIGINT, 'Red Ring', 'https://h', '/p.png#f', 'Rr', 'Ann Lee', '7', false, false, false, false),
  (13, '', '', '', '', 'Ann Lee', '7', false, false, false, false), (14, 'T', '', '', '', '', '', true, false, true, true),
  (15, 'T', '', '', '', '', '', false, true, true, false), (16, 'T', '', '', '', '', '', false, false, false, false),
  (17, 'T', '', '', '', '', '', true, false, true, true), (18, 'T', '', '', '', '', '', false, false, false, true))
  v(id, title, cover_base, cover_path, aliases, authors, tag_ids, hidden, is_hide_chapter, need_login, is_lock)""",
)
def ingest_json(spark, sf_dir):
    entries = json_documents.parse(spark.createDataFrame(list(DIRTY), "id long, json string"))
    docs = index.build(entries).docs
    return docs.select(
        "id",
        "title",
        "cover_base",
        "cover_path",
        F.array_join("aliases", "/").alias("aliases"),
        F.array_join("author_names", "/").alias("authors"),
        F.array_join(F.transform("tag_ids", lambda t: t.cast("string")), "/").alias("tag_ids"),
        "hidden",
        "is_hide_chapter",
        "need_login",
        "is_lock",
    )


@_query("ingest_tags", "SELECT 7::INT AS tag_id, 'a' AS name, 4::BIGINT AS count, 0::INT AS bit")
def ingest_tags(spark, sf_dir):
    return index.tag_dictionary(json_documents.parse(spark.createDataFrame(list(DIRTY), "id long, json string")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}


__all__ = ["FOUND", "oracle_sql", "queries"]
