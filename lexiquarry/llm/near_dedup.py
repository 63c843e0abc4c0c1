"""Near-duplicates by MinHash with tensored banding.

A document is its set of distinct five-word shingles (64-bit hashes); two documents are linked if the
Jaccard similarity of their sets is at least 0.75. Instead of computing rows x tables minhashes, two
collections of `tables` short bands are computed, and every pair (i, j) of a band from each makes a table
key: 2 * rows * tables minhashes serve tables² tables. At rows = 2 and tables = 10 a pair of similarity 0.75
meets in one of the 100 tables with probability 1 - 0.0005, one of 0.8 with 1 - 0.00007.

Texts with equal sets are one class; only a class's first document is banded. In each table, members of a
bucket are paired with the bucket's center (a star), the one with the most company over all its buckets, and
each pair is confirmed on the full sets. Components come from rounds of large-star and small-star steps on
tables in the shared folder. Where a bucket then still spans several components, its members are loose: among
all loose members, the links across components are found exactly, by a join on prefixes. Shingles are ordered
by how many loose members have them, rare ones first; two sets that are similar enough share one of the first
places of both. So no two documents that share a bucket are left apart untested, and a crowd that shares a
long passage without being similar meets at few shingles, as its own come first.

Defined results: words are split at ASCII white space, A to Z lower-cased. A text of one to four words has
its whole sequence as its only shingle; a null, empty or blank text has none and is linked with nothing. A
row without doc_id is linked with nothing, has a null component_id and is kept. Equal rows get equal
results. Rows of one doc_id with different texts belong together, and each has its own n_shingles. Empty
tables give empty results; other columns are ignored. Sets are of 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

WORDS = 5
#: Members of a token that are paired in one task, with as many others.
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of text's shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    if len(h) < n:
        n = len(h)
    size = len(h) - n + 1
    total = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _ODD + h[k : k + size]
        return np.unique(_mix(total))


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)
    return base[:count] | np.uint64(1), base[count:]


def bands(hashes: np.ndarray, rows: int, tables: int) -> list[int]:
    """2 * tables band values: `tables` of the first collection, then of the second."""
    times, plus = seeds(2 * rows * tables)
    lows = np.empty(2 * rows * tables, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(lows)):
            x = hashes * times[k] + plus[k]
            lows[k] = (x ^ (x >> np.uint64(32))).min() if len(x) else 0
        lows = lows.reshape(2 * tables, rows)
        out = np.arange(2 * tables, dtype=np.uint64)
        for k in range(rows):
            out = _mix(out * _ODD + lows[:, k])
    return out.view(np.int64).tolist()


def signatures(docs: DataFrame, rows: int, tables: int) -> DataFrame:
    """(doc_id, n_shingles, same, bands): same is a digest of the set, null without shingles or doc_id."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets = [shingles(t) for t in texts]
                linked = [len(s) > 0 and i is not None for s, i in zip(sets, ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if x else None for s, x in zip(sets, linked)], pa.binary()),
                        pa.array([bands(s, rows, tables) if x else None for s, x in zip(sets, linked)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "same", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, same binary, bands array<long>"
    )


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, sets): the sorted hashes of each text's shingles."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; sets is (doc_id, shingles)."""
    # Pairs and their documents grow with the input: they are shuffled, never broadcast.
    with_a = pairs.select("a", "b").hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    same, sizes = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    counted = both.select("a", "b", same.cast("long").alias("same"), sizes.cast("long").alias("sizes"))
    return counted.where((100 + percent) * F.col("same") >= percent * F.col("sizes")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b)."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.select(low.alias("a"), high.alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        # Large star: every larger neighbour of a node goes to the smallest node around it.
        around = now.union(now.select("b", "a")).toDF("u", "v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = materialize(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _least_both(n, m, percent: int):
    """How many shingles sets of these sizes share at least, if they are similar enough."""
    return F.ceil(percent * (n + m) / (100 + percent))


def meetings(member: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members (token, rep, n, place, component) that meet at a token and may be similar enough.

    place is the token's place in its set's order. If the token is the first that both have, they can share no more
    than it and what comes after it in either. A token's members are dealt into parts of about `block` by a hash, and
    any two parts meet apart from the others, so that a hot token is spread over as many tasks as it has pairs for.
    """
    spans = member.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("parts")
    )
    # As a table, so that the join of two shuffled sides can be split at a hot token.
    spans = materialize(spans.where("lo < hi").select("token", "parts"), "spans")
    dealt = member.join(spans, "token").withColumn(
        "part", F.pmod(F.xxhash64("rep", "token"), F.col("parts")).cast("int")
    )
    held = ("rep", "n", "place", "component")
    left = dealt.select("token", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.struct(*held).alias("x"))
    right = dealt.select("token", F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"), F.struct(*held).alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    reachable = F.least(n - F.col("x.place"), m - F.col("y.place"))
    met = left.join(right, ["token", "p", "q"]).where(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("p") < F.col("q")) | (F.col("x.rep") < F.col("y.rep")))
        & (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (reachable >= _least_both(n, m, percent))
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def prefixes(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(token, rep, n, place): the shingles with which each set begins, rare ones first, as far as any set similar
    enough to it must have one of them too. What only one set has is left out, but counts in the places."""
    # What is derived from a whole set stands below the explode, or it would be derived again for each shingle.
    sized = sets.select("rep", "component", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("of"), "shingles")
    tokens = sized.select("rep", "component", "n", "of", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    last = Window.partitionBy("rep", "of").orderBy(F.desc("df"), F.desc("token"))
    placed = tokens.join(common, "token").select("token", "rep", "n", "component", (F.col("n") - F.row_number().over(last)).alias("place"))
    return placed.where(F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100))


def shared_buckets(classes: DataFrame, tables: int) -> DataFrame:
    """(key, rep, n) of the classes (rep, n, bands) that share a table key with another one.

    A class can only share a key if it shares both of its bands, so bands are counted first (2 * tables rows for a
    class), and keys (tables²) are made of shared bands only.
    """
    bands_ = classes.select("rep", "n", F.posexplode("bands").alias("at", "band"))
    common = bands_.groupBy("at", "band").agg(F.count("*").alias("size")).where("size > 1").select("at", "band")
    held = bands_.join(common, ["at", "band"]).groupBy("rep", "n").agg(F.collect_list(F.struct("at", "band")).alias("held"))
    first, second = F.filter("held", lambda x: x["at"] < tables), F.filter("held", lambda x: x["at"] >= tables)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["at"], x["band"], y["at"], y["band"]))))
    banded = materialize(held.select("rep", "n", F.explode(keys).alias("key")), "keys")
    many = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return banded.join(many, "key")


def near_duplicates(docs: DataFrame, rows: int = 2, tables: int = 10, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = materialize(signatures(docs, rows, tables), "signatures")
    classes = signed.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").cast("int").alias("n"))
    classes = materialize(classes, "classes")
    # Rows of one doc_id with different texts are in several classes, which are linked.
    torn = signed.where("same is not null").groupBy("doc_id").agg(F.min("same").alias("s"), F.max("same").alias("t")).where("s <> t").select("doc_id")
    torn = signed.join(torn, "doc_id").join(classes.select("same", "rep"), "same").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    shared = materialize(shared_buckets(classes, tables), "buckets")
    # A bucket's center is the member with the most company over all its buckets: the one that the others are copies of.
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    shared = materialize(shared.join(company, "rep").select("key", "rep", "n", "company"), "members")
    centers = shared.groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("last"), "n")).alias("c"))
    star = shared.join(centers.select("key", (-F.col("c.last")).alias("center"), F.col("c.n").alias("m")), "key")
    star = star.where((F.col("rep") != F.col("center")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    tried = materialize(star.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct(), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(shingle_sets(texts.hint("merge").join(reps, "doc_id", "left_semi")), "sets")
    links = materialize(confirmed(tried, sets, percent).union(torn), "links")
    # The star leaves pairs untried where a bucket still spans several components: among all members of such
    # buckets, the pairs that can be similar enough are found by prefixes, whatever buckets they share.
    member = shared.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_keys = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    loose = member.join(open_keys, "key").select(F.col("rep").alias("doc_id"), "component").distinct()
    loose = materialize(loose, "loose")
    begun = materialize(prefixes(sets.join(loose, "doc_id").withColumnRenamed("doc_id", "rep"), percent), "prefixes")
    rest = materialize(meetings(begun, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = confirmed(rest, sets, percent)
    reached = components(links.union(materialize(found, "links"))).withColumnRenamed("node", "rep")
    of_class = classes.join(reached, "rep", "left").select("same", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "same").join(of_class, "same", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """One row of docs for each group, columns unchanged: the first document's, and of several rows with its doc_id
    the one of the least text. Rows without doc_id stay."""
    verdict = near_duplicates(docs, **parameters).where("doc_id is not null")
    fate = verdict.groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    fate = materialize(fate.where("not __kept or __rows > 1"), "fates")
    same = F.col("doc_id").cast("long") == F.col("__id")
    alone = docs.join(fate, same, "left_anti")
    many = fate.where("__kept").select("__id")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    return alone.union(
        docs.join(many, same, "left_semi").withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")
    )
