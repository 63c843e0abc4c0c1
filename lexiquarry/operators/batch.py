"""Many requests in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.request import MODES, SORTS, parse
from ..sources.shared import materialize
from .index import Catalog
from .search import BOOSTS, FLAGS

_TERM = T.StructType(
    [
        T.StructField("exclude", T.BooleanType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("grams", T.ArrayType(T.StringType())),
    ]
)
@F.udf(T.ArrayType(_TERM), useArrow=True)
def _terms(q):
    include, exclude = parse(q or "")
    usable = lambda t: [g for g in t.grams if not any("\ud800" <= c <= "\udfff" for c in g)]
    return [(out, k, t.text, t.n, usable(t)) for out, terms in ((False, include), (True, exclude)) for k, t in enumerate(terms)]


def normalised(requests: DataFrame) -> DataFrame:
    """requests with all columns of a request; missing ones and nulls get their defaults, page and size their bounds.
    Modes and sorts that there are not fail the job."""
    have, no_tags = set(requests.columns), F.array().cast("array<int>")
    defaults = {"tags": no_tags, "exclude_tags": no_tags, **{mode: F.lit("any") for mode, _ in FLAGS}, "sort": F.lit("relevance"), "page": F.lit(1), "size": F.lit(20)}
    filled = requests.select("request_id", "q", *[(F.coalesce(F.col(c), d) if c in have else d).alias(c) for c, d in defaults.items()])
    right = reduce(lambda a, b: a & b, [F.col(name).isin(*MODES) for name, _ in FLAGS], F.col("sort").isin(*SORTS))
    size = F.least(F.greatest(F.col("size"), F.lit(1)), F.lit(100)).cast("long")
    checked = filled.withColumn("sort", F.when(right, F.col("sort")).otherwise(F.raise_error(F.lit("a mode or sort that there is not"))))
    filtered = reduce(lambda a, b: a | b, [F.col(name) != "any" for name, _ in FLAGS], (F.size("tags") > 0) | (F.size("exclude_tags") > 0))
    checked = checked.withColumns({"size": size, "skip": (F.greatest(F.col("page"), F.lit(1)) - 1) * size, "filtered": filtered})
    return checked.withColumnsRenamed({mode: f"wanted_{mode}" for mode, _ in FLAGS})


def _passes() -> Column:
    """A document's tags and flags against a request's, as columns side by side."""
    found = F.forall("tags", lambda t: F.array_contains("tag_ids", t)) & ~F.arrays_overlap("tag_ids", F.col("exclude_tags"))
    for mode, column in FLAGS:
        found = found & ((F.col(f"wanted_{mode}") == "any") | ((F.col(f"wanted_{mode}") == "only1") == F.col(column)))
    return found


#: Up to so many rows of requests' grams are sent to every task; of more, both sides are dealt out by gram.
BESIDE = 50_000


def search_many(catalog: Catalog, requests: DataFrame, together: int = 10_000) -> DataFrame:
    """(request_id, rank, id, score, total, has_more): the page of each row of requests, as search() gives it.

    requests: request_id, q and, where wanted, the other columns of a request. Postings are joined by gram, counted by
    request, term and document, and ranked within each request, of which each task passes on a page at most. Requests
    without a term to include run over all documents, side by side in one scan; there may be `together` of them.

    Requests as read, their known grams and all matches (request_id, id, score) are written to the shared folder, each
    once; the result reads them there. Requests, their grams and the dictionary of authors may be broadcast. Documents,
    postings and matches are not, whatever size Spark expects of them; only names of a document's authors may be, if
    they turn out at run time to be below Spark's threshold.
    """
    asked = materialize(normalised(requests).withColumn("terms", _terms("q")).drop("q"), "requests")
    terms = asked.select("request_id", F.explode("terms").alias("t")).select("request_id", "t.*")
    grams = terms.select("request_id", "exclude", "k", "n", F.explode("grams").alias("gram"))
    some = grams.limit(BESIDE + 1).count() <= BESIDE
    # Left to itself, Spark may broadcast the large side: a small file can have many rows.
    beside = lambda large, few: large.join(F.broadcast(few), "gram") if some else large.hint("merge").join(few, "gram")
    found = F.count("*").over(Window.partitionBy("request_id", "exclude", "k")).cast("int")
    known = materialize(beside(catalog.grams.select("gram"), grams).withColumn("f", found), "request-grams")
    counted = beside(catalog.postings.select("gram", "id"), known).groupBy("request_id", "exclude", "k", "n", "f", "id").agg(F.count("*").alias("hit"))
    least = F.least(F.greatest(F.lit(1), F.floor((3 * F.col("n") + 4) / 5)), F.col("f"))
    hit = counted.where(F.col("hit") >= least)
    matched = hit.select("request_id", "id", "exclude", F.when(~F.col("exclude"), F.struct("k", (F.col("hit") / F.col("n")).alias("part"))).alias("part"))
    include = F.transform(F.filter("terms", lambda t: ~t["exclude"]), lambda t: t["term"])
    facts = ["id", "tag_ids", *[c for _, c in FLAGS]]
    # No term to include: all documents that pass, if there is a term to exclude or a filter.
    rest = asked.where((F.size(include) == 0) & ((F.size("terms") > 0) | F.col("filtered")))
    few = rest.limit(together + 1).count()
    if few > together:
        raise ValueError(f"more than {together} requests without a term to include; deal them out over several calls")
    if few:
        wanted = rest.select("request_id", "tags", "exclude_tags", *[f"wanted_{mode}" for mode, _ in FLAGS])
        scanned = catalog.docs.select(*facts).join(F.broadcast(wanted), how="cross").where(_passes())
        no_part = F.lit(None).cast(matched.schema["part"].dataType).alias("part")
        matched = matched.unionByName(scanned.select("request_id", "id", F.lit(False).alias("exclude"), no_part))
    # A document goes if a term to exclude has it; what only such a term has was not asked for.
    per = matched.repartition("id").groupBy("request_id", "id").agg(F.bool_or("exclude").alias("gone"), F.array_sort(F.collect_list("part")).alias("parts"))
    settings = asked.select("request_id", "tags", "exclude_tags", *[f"wanted_{mode}" for mode, _ in FLAGS], "sort", include.alias("terms"))
    docs = catalog.docs.select(*facts, *[c for c, _ in BOOSTS]).hint("merge")
    rows = per.where("not gone").drop("gone").join(docs, "id").join(settings, "request_id").where(_passes())
    folded = F.aggregate("parts", F.lit(0.0).cast("float"), lambda a, x: (a.cast("double") + x["part"]).cast("float")).cast("double")
    # One term alone is rounded only in the end; several without relevance aren't scored.
    base = F.when(F.size("terms") > 1, folded).otherwise(F.get("parts", F.lit(0))["part"])

    def add(a, x):
        for column, boost in BOOSTS:
            a = a + F.when(F.contains(F.col(column), x), F.lit(boost)).otherwise(F.lit(0.0))
        return a

    score = F.aggregate("terms", base, add).cast("float").cast("double")
    plain = (F.size("terms") > 1) & (F.col("sort") != "relevance")
    scored = F.when(F.size("terms") == 0, 0.0).when(plain, 1.0).otherwise(score)
    ranked = materialize(rows.select("request_id", "id", scored.alias("score")), "matches")
    total = ranked.groupBy("request_id").agg(F.count("*").alias("total"))
    last = asked.agg(F.max(F.col("skip") + F.col("size"))).first()[0] or 0
    first = F.when(F.col("sort") == "relevance", F.col("score")).otherwise(0.0)
    then = F.when(F.col("sort") == "id_asc", F.col("id")).otherwise(-F.col("id"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(first.desc(), then.asc()))
    # Every match has its request; a left join keeps Spark from broadcasting the matches.
    cut = ranked.join(asked.select("request_id", "sort", "skip", "size"), "request_id", "left").withColumn("rank", place.cast("long")).where(F.col("rank") <= last)
    cut = cut.where((F.col("rank") > F.col("skip")) & (F.col("rank") <= F.col("skip") + F.col("size"))).join(total, "request_id")
    return cut.select("request_id", "rank", "id", "score", "total", (F.col("skip") + F.col("size") < F.col("total")).alias("has_more"))
