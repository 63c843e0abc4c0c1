"""Fuzzy search over a catalogue.

The request's few grams are looked up in the dictionary first; what they give (how many are known) sets each
term's threshold as a literal. Postings of those grams are then counted by document and term in one shuffle. In a
saved catalogue both read the shards of the grams only. Filters meet the counts by id and flags alone. For order by
relevance, texts are read only of documents that can still reach the page; a page's rows, at most 100, come to the
driver, and only they are looked up among the documents, by literal ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import gram_key_of, gram_shard_of
from ..plans.request import Request, Term, parse, resolve_tags, threshold
from .index import Catalog

BOOSTS = (("title_norm", 1.4), ("aliases_norm", 0.6), ("authors_norm", 0.4))
FLAGS = (("hidden", "hidden"), ("hide_chapter", "is_hide_chapter"), ("need_login", "need_login"), ("lock", "is_lock"))


def passes(request: Request) -> Column:
    """Tags: all wanted, none excluded; flags by their modes."""
    found = []
    for t in request.tags:
        found.append(F.array_contains("tag_ids", F.lit(t)))
    if request.exclude_tags:
        found.append(~F.arrays_overlap("tag_ids", F.array(*[F.lit(t) for t in request.exclude_tags])))
    for mode, column in FLAGS:
        if (wanted := getattr(request, mode)) != "any":
            found.append(F.col(column) if wanted == "only1" else ~F.col(column))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def of_grams(catalog: Catalog, table: DataFrame, grams: list[str]) -> DataFrame:
    """The rows of these grams; in a saved catalogue, out of the folders of their shards only."""
    rows = table.where(F.col("gram").isin(grams))
    if catalog.shards is None:
        return rows
    return rows.where(F.col("shard").isin(sorted({gram_shard_of(gram_key_of(g), catalog.shards) for g in grams})))


def known_grams(catalog: Catalog, terms: tuple[Term, ...]) -> set[str]:
    """Of the terms' grams those in the dictionary; no more than the request has."""
    wanted = sorted({g for t in terms for g in t.grams if not any("\ud800" <= c <= "\udfff" for c in g)})
    if not wanted:
        return set()
    return {r["gram"] for r in of_grams(catalog, catalog.grams, wanted).select("gram").collect()}


def hits(catalog: Catalog, terms: tuple[Term, ...], known: set[str]) -> DataFrame | None:
    """(id, h0, h1, ...): by document the grams shared with each term, where one term reaches its threshold."""
    own = [[g for g in t.grams if g in known] for t in terms]
    every = sorted({g for gs in own for g in gs})
    if not every:
        return None
    posted = of_grams(catalog, catalog.postings, every)
    counts = [F.count(F.when(F.col("gram").isin(gs) if gs else F.lit(False), 1)).alias(f"h{k}") for k, gs in enumerate(own)]
    enough = [F.col(f"h{k}") >= threshold(t.n, len(gs)) for k, (t, gs) in enumerate(zip(terms, own)) if gs]
    return posted.groupBy("id").agg(*counts).where(reduce(lambda a, b: a | b, enough))


def base_score(request: Request, terms: tuple[Term, ...], known: set[str]) -> Column:
    """The share of grams found, in a double; with several terms rounded to 32 bits after each."""
    parts = []
    for k, t in enumerate(terms):
        found = sum(g in known for g in t.grams)
        if found:
            parts.append((F.when(F.col(f"h{k}") >= threshold(t.n, found), F.col(f"h{k}")).otherwise(0) / F.lit(t.n)).cast("double"))
    if len(terms) == 1:
        return parts[0]
    if request.sort != "relevance":
        return F.lit(1.0).cast("double")
    score = F.lit(0.0)
    for part in parts:
        score = (score + part).cast("float").cast("double")
    return score


def boosted(request: Request, terms: tuple[Term, ...], base: Column) -> Column:
    """The score as a 32-bit float: base, and what the whole terms add where a text has them."""
    if len(terms) > 1 and request.sort != "relevance":
        return base.cast("float")
    for t in terms:
        for column, boost in BOOSTS:
            base = base + F.when(F.contains(F.col(column), F.lit(t.text)), F.lit(boost)).otherwise(F.lit(0.0))
    return base.cast("float")


def candidates(catalog: Catalog, request: Request) -> tuple[DataFrame, tuple[Term, ...]]:
    """(id, base) of all matching documents, in no order, and the terms whose boosts are still to be added."""
    include, exclude = parse(request.q)
    docs = catalog.docs.where(passes(request)) if request.filtered else catalog.docs
    none = docs.select("id", F.lit(0.0).cast("double").alias("base"))
    if not include and not exclude:
        return (none if request.filtered else none.limit(0)), ()
    known = known_grams(catalog, include + exclude)
    if include:
        found = hits(catalog, include, known)
        if found is None:
            return none.limit(0), ()
        out = found.select("id", base_score(request, include, known).alias("base"))
        if request.filtered:
            out = out.join(docs.select("id"), "id", "left_semi")
    else:
        out = none
    if exclude and (gone := hits(catalog, exclude, known)) is not None:
        out = out.join(gone.select("id"), "id", "left_anti")
    return out, include


def matches(catalog: Catalog, request: Request) -> DataFrame:
    """(id, score) of all matching documents, in no order."""
    found, terms = candidates(catalog, request)
    if not terms:
        return found.select("id", F.col("base").cast("float").alias("score"))
    return found.join(catalog.docs, "id").select("id", boosted(request, terms, F.col("base")).alias("score"))


def order(request: Request) -> list[Column]:
    include, _ = parse(request.q)
    if request.sort == "id_asc":
        return [F.asc("id")]
    return [F.desc("score"), F.desc("id")] if request.sort == "relevance" and include else [F.desc("id")]


PAGE = "rank long, id long, score double, total long, has_more boolean"


def page_of(catalog: Catalog, found: DataFrame, terms: tuple[Term, ...], request: Request) -> DataFrame:
    """The request's page of candidates (id, base): rank from 1, id, score, total and has_more, at most 100 rows.

    One pass counts and cuts. By relevance, that pass cuts by base alone; a document whose base is less than that of
    the page's last by more than all boosts can't be on the page, and texts are read of the others only.
    """
    spark, end = found.sparkSession, request.offset + request.limit
    counted = Observation()
    seen = found.observe(counted, F.count(F.lit(1)).alias("total"))
    if terms and request.sort == "relevance":
        last = seen.orderBy(F.desc("base")).limit(end).agg(F.min("base"), F.count("*")).first()
        total = counted.get["total"]
        rows = []
        if total > request.offset:
            most = sum(b for _, b in BOOSTS) * len(terms) + 1e-3
            near = found.where(F.col("base") >= last[0] - most) if last[1] == end else found
            scored = near.join(catalog.docs.select("id", *[c for c, _ in BOOSTS]), "id").select("id", boosted(request, terms, F.col("base")).alias("score"))
            rows = scored.orderBy(*order(request)).offset(request.offset).limit(request.limit).collect()
    else:
        rows = seen.orderBy(*(F.asc("id") if request.sort == "id_asc" else F.desc("id"),)).offset(request.offset).limit(request.limit).select("id", "base").collect()
        total = counted.get["total"]
        if terms and rows and len(terms) == 1:
            few = catalog.docs.where(F.col("id").isin([r["id"] for r in rows])).select("id", *[c for c, _ in BOOSTS])
            few = few.join(F.broadcast(spark.createDataFrame(rows, "id long, base double")), "id")
            rows = few.select("id", boosted(request, terms, F.col("base")).alias("score")).orderBy(*order(request)).collect()
    out = [(request.offset + k + 1, r[0], float(r[1]), total, end < total) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, PAGE)


def hydrate(catalog: Catalog, cut: DataFrame) -> DataFrame:
    """The items of a page. Its ids, at most 100, are literals in the scan of the documents."""
    docs = catalog.docs.where(F.col("id").isin([r["id"] for r in cut.select("id").collect()])).join(F.broadcast(cut), "id")
    tagged = docs.select("id", F.explode("tag_ids").alias("tag_id")).join(catalog.tags.select("tag_id", "name"), "tag_id")
    tags = tagged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tag_id", "name"))).alias("tags"))
    return docs.join(tags, "id", "left").select(
        "rank",
        "id",
        "title",
        F.concat("cover_base", "cover_path").alias("cover"),
        "aliases",
        F.col("author_names").alias("authors"),
        F.coalesce("tags", F.array().cast("array<struct<tag_id:int,name:string>>")).alias("tags"),
        "hidden",
        "is_hide_chapter",
        "need_login",
        "is_lock",
        "score",
        "total",
        "has_more",
    )


#: A status and what it is called, in the order of display.
STATUS = (("hidden", "hidden"), ("is_hide_chapter", "chapters hidden"), ("need_login", "login needed"), ("is_lock", "locked"))


def details(items: DataFrame, address: str = "detail?id=") -> DataFrame:
    """items of a page as they are shown: address of the entry, aliases as one text, names of statuses that hold."""
    holds = F.array(*[F.when(F.col(c), F.lit(name)) for c, name in STATUS])
    return items.select(
        "rank",
        "id",
        F.concat(F.lit(address), F.col("id").cast("string")).alias("href"),
        "title",
        F.array_join("aliases", " / ").alias("alias_text"),
        F.array_compact(holds).alias("status"),
    )


def search(catalog: Catalog, request: Request) -> DataFrame:
    """(rank, id, score, total, has_more) of the page."""
    found, terms = candidates(catalog, request)
    found = found.persist()
    try:
        return page_of(catalog, found, terms, request)
    finally:
        found.unpersist()


class Searcher:
    """Searches a catalogue. The candidates of the last request are kept, so that another page of it is only cut anew.

    A search that comes while an older one is running interrupts that one's jobs: the latest request wins, and the
    older call raises Superseded.
    """

    def __init__(self, catalog: Catalog, tell: Callable[[str], None] | None = None):
        self.catalog, self._key, self._found, self._terms = catalog, None, None, ()
        self._tell, self._latest = tell or (lambda step: None), 0
        self._names: dict[int, str] | None = None

    def search(self, request: Request) -> DataFrame:
        context = self.catalog.docs.sparkSession.sparkContext
        self._latest += 1
        mine, tag = self._latest, f"search-{id(self)}-{self._latest}"
        context.cancelJobsWithTag(f"search-{id(self)}-{mine - 1}")
        context.addJobTag(tag)
        try:
            return self._answer(request)
        except Exception as e:
            if mine != self._latest:
                raise Superseded(request) from e
            raise
        finally:
            context.removeJobTag(tag)

    def _answer(self, request: Request) -> DataFrame:
        key = request.key()
        if key != self._key:
            self.release()
            self._tell("looking up")
            found, terms = candidates(self.catalog, request)
            self._key, self._found, self._terms = key, found.persist(), terms
        self._tell("ranking")
        cut = page_of(self.catalog, self._found, self._terms, request)
        self._tell("fetching items")
        return hydrate(self.catalog, cut)

    def release(self) -> None:
        """Forget the last request."""
        if self._found is not None:
            self._found.unpersist()
        self._key, self._found, self._terms = None, None, ()

    def choose(self, tags=(), exclude=(), **rest) -> Request:
        """A request by ids or names of tags; unknown ones are left out. The tag dictionary is kept on the driver."""
        if self._names is None:
            self._names = {r["tag_id"]: r["name"] for r in self.catalog.tags.select("tag_id", "name").collect()}
        chosen, gone = resolve_tags(self._names, tuple(tags), tuple(exclude))
        return Request(tags=chosen, exclude_tags=gone, **rest)

    def by_author(self, name: str, **rest) -> DataFrame:
        """An author's name as the text: it searches all fields, and a blank in it makes two terms."""
        return self.search(Request(q=name, **rest))

    def by_tag(self, tag_id: int, **rest) -> DataFrame:
        return self.search(Request(tags=(tag_id,), **rest))


class Superseded(RuntimeError):
    """A later request came while this one was answered."""
