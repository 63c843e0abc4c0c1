"""Search against a brute-force model of its definition."""

import json
import random
import re
import sqlite3
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions.text import SEPARATOR, norm_of, request_grams
from lexiquarry.__main__ import main
from lexiquarry.operators import batch, index
from lexiquarry.operators.index import Catalog
from lexiquarry.operators.search import Searcher, Superseded, of_grams, search
from lexiquarry.plans.request import Request, parse, threshold
from lexiquarry.sources import json_documents, sqlite, store

SCHEMA = (
    "src_id long, id long, title string, cover string, aliases array<string>, authors array<struct<author_id:int,name:string>>, "
    "tags array<struct<tag_id:int,name:string>>, hidden boolean, is_hide_chapter boolean, need_login boolean, is_lock boolean"
)


def entries(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcＡé漢😀") for _ in range(r.randint(0, 6)))
    flag = lambda: r.random() < 0.3
    rows = []
    for k in range(n):
        authors = [(r.randint(1, 5), word() or "x") for _ in range(r.randint(0, 3))]
        tags = [(r.randint(1, 6), r.choice([None, "", "t"])) for _ in range(r.randint(0, 3))]
        rows.append((k, None if r.random() < 0.05 else k + 1, word() + " " + word(), "", [word() or "y" for _ in range(r.randint(0, 2))], authors, tags, flag(), flag(), flag(), flag()))
    return rows


def model(rows: list[tuple], q: Request) -> list[tuple[int, float]]:
    canonical: dict[int, str] = {}
    for x in rows:
        if x[1] is not None:
            for a, name in x[5]:
                canonical.setdefault(a, name)
    docs, index_ = {}, {}
    for x in rows:
        if x[1] is None:
            continue
        texts = [x[2], *x[4], *(name for _, name in x[5])]
        grams = {t[i : i + 2] for t in map(norm_of, texts) for i in range(len(t) - 1)}
        for g in grams:
            if all(ord(c) < 65536 for c in g):
                index_.setdefault(g, set()).add(x[1])
        joined = [norm_of(t) for t in (x[2], SEPARATOR.join(x[4]), SEPARATOR.join(canonical[a] for a, _ in x[5]))]
        docs[x[1]] = (x, joined)
    include, exclude = ([t.text for t in ts] for ts in parse(q.q))

    def hit(term):
        grams = request_grams(term)
        known = [g for g in grams if g in index_]
        if not known:
            return {}
        counts: dict[int, int] = {}
        for g in known:
            for d in index_[g]:
                counts[d] = counts.get(d, 0) + 1
        return {d: c / len(grams) for d, c in counts.items() if c >= threshold(len(grams), len(known))}

    def passes(x):
        tags = {t for t, _ in x[6]}
        flags = zip((q.hidden, q.hide_chapter, q.need_login, q.lock), x[7:11])
        return set(q.tags) <= tags and not tags & set(q.exclude_tags) and all(m == "any" or f == (m == "only1") for m, f in flags)

    if not include and not exclude and not q.filtered:
        return []
    gone = {d for t in exclude for d in hit(t)}
    hits = [hit(t) for t in include]
    out = []
    for d, (x, joined) in docs.items():
        if not passes(x) or d in gone or include and not any(d in h for h in hits):
            continue
        score = 0.0
        if len(include) > 1 and q.sort != "relevance":
            score = 1.0
        elif include:
            if len(include) > 1:
                for h in hits:
                    score = float(np.float32(score + h.get(d, 0.0)))
            else:
                score = hits[0][d]
            for t in include:
                for text, boost in zip(joined, (1.4, 0.6, 0.4)):
                    if t in text:
                        score += boost
            score = float(np.float32(score))
        out.append((d, score))
    if q.sort == "id_asc":
        return sorted(out)
    return sorted(out, key=lambda p: (-p[1], -p[0]) if q.sort == "relevance" and include else (-p[0],))


REQUESTS = [
    Request(q="abca"),
    Request(q="ab ca -é漢", size=7, page=2),
    Request(q="a漢b bb cab", size=100),
    Request(q="ab bc", sort="id_asc"),
    Request(q="ab bc", sort="id_desc", hidden="only0"),
    Request(q="-ab"),
    Request(q="-zzzz"),
    Request(q="zzzz"),
    Request(q="😀a ab"),
    Request(q="a😀bc", size=100),
    Request(),
    Request(q="a"),
    Request(tags=(2,), exclude_tags=(3,), lock="only0", sort="id_asc"),
    Request(q="cb", need_login="only1", hide_chapter="only0"),
    Request(q="ab", page=99),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_follows_the_model(spark, seed):
    rows = entries(seed)
    catalog = index.build(spark.createDataFrame(rows, SCHEMA)).cached()
    for q in REQUESTS:
        want = model(rows, q)
        got = search(catalog, q).orderBy("rank").collect()
        assert [(r.id, r.score) for r in got] == want[q.offset : q.offset + q.limit], q
        assert all(r.total == len(want) and r.has_more == (q.offset + q.limit < len(want)) for r in got)
    many = [(k, q.q, list(q.tags), list(q.exclude_tags), q.hidden, q.hide_chapter, q.need_login, q.lock, q.sort, q.page, q.size) for k, q in enumerate(REQUESTS)]
    schema = "request_id long, q string, tags array<int>, exclude_tags array<int>, hidden string, hide_chapter string, need_login string, lock string, sort string, page int, size int"
    found = {}
    for r in batch.search_many(catalog, spark.createDataFrame(many, schema)).orderBy("request_id", "rank").collect():
        found.setdefault(r.request_id, []).append((r.id, r.score))
    for k, q in enumerate(REQUESTS):
        assert found.get(k, []) == model(rows, q)[q.offset : q.offset + q.limit], q
    catalog.release()


def broadcast_rows(spark, run) -> list[int]:
    """The rows of each table that run() broadcasts, by Spark's own count."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    bus.waitUntilEmpty(30_000)
    before = {e.executionId() for e in listed(store.executionsList())}
    run()
    bus.waitUntilEmpty(30_000)
    found = []
    for e in {e.executionId() for e in listed(store.executionsList())} - before:
        values = store.executionMetrics(e)
        for node in listed(store.planGraph(e).allNodes()):
            for m in listed(node.metrics()) if node.name().startswith("BroadcastExchange") else ():
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    found.append(int(v.get().replace(",", "")))
    return found


@pytest.mark.parametrize("beside", [batch.BESIDE, 1])
def test_batch_broadcasts_no_table_that_grows(spark, tmp_path, monkeypatch, beside):
    """Small files of many rows: Spark, left to itself, takes documents and postings for small and broadcasts them."""
    monkeypatch.setattr(batch, "BESIDE", beside)
    rows = [(k, k + 1, f"ring {k % 7} bolt", "", ["steel"], [(k % 5, f"brand {k % 5} " * 20)], [(k % 3, "t")], k % 2 == 0, False, False, False) for k in range(3000)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "entries"))
    assert sum(p.stat().st_size for p in (tmp_path / "entries").glob("*.parquet")) < 100 * 1024
    catalog = index.build(spark.read.parquet(str(tmp_path / "entries")), ascii_only=True)
    requests = [Request(q="ring brand3"), Request(q="bolt -brand2"), Request(q="-brand4"), Request(tags=(2,))]
    asked = spark.createDataFrame([(k, q.q, list(q.tags)) for k, q in enumerate(requests)], "request_id long, q string, tags array<int>")
    found, threshold_ = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold_, "100k")  # above the file's size, below that of the rows in memory
    try:
        sizes = broadcast_rows(spark, lambda: found.extend(batch.search_many(catalog, asked).orderBy("request_id", "rank").collect()))
    finally:
        spark.conf.unset(threshold_)
    assert sizes and max(sizes) < 300, sizes
    for k, q in enumerate(requests):
        want = model(rows, q)
        assert [(r.id, r.score, r.total) for r in found if r.request_id == k] == [(*w, len(want)) for w in want[:20]], q


def test_saved_catalogue_and_paging(spark, tmp_path):
    rows, steps, folder = entries(3), [], str(tmp_path / "c")
    built = index.build(spark.createDataFrame(rows, SCHEMA))
    made = store.save(built, folder, tell=lambda *x: steps.append(x), shard_docs=10)
    assert steps[-1] == ("postings", 5, 5) and made["stats"]["count"] == sum(r[1] is not None for r in rows)
    catalog = store.load(spark, folder).warm()
    searcher = Searcher(catalog, steps.append)
    want = model(rows, Request(q="ab"))
    for page in (1, 2):
        items = searcher.search(Request(q="ab", size=5, page=page)).orderBy("rank").collect()
        assert [r.id for r in items] == [d for d, _ in want[5 * page - 5 : 5 * page]]
    assert steps.count("looking up") == 1
    assert {t.tag_id for r in searcher.by_tag(2).collect() for t in r.tags} >= {2}
    assert searcher.by_author("").count() == 0
    assert searcher.choose((2, 99, 2), (2, 3)) == Request(tags=(2,), exclude_tags=(3,))
    searcher.release()
    catalog.release()


def test_only_shards_of_the_grams_are_read(spark, tmp_path):
    store.save(index.build(spark.createDataFrame(entries(3), SCHEMA)), str(tmp_path / "c"))
    catalog = store.load(spark, str(tmp_path / "c"))
    for table in (catalog.grams, catalog.postings):
        rows = of_grams(catalog, table, ["ab"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ (=|IN) ", plan), plan
        assert len({f.split("shard=")[1].split("/")[0] for f in rows.inputFiles()}) >= 1
        assert rows.select("shard").distinct().count() == 1


def test_store_names_cleans_and_checks(spark, tmp_path):
    folder = tmp_path / "c"
    tables = lambda: sorted(x.name for x in folder.iterdir() if not x.name.startswith("."))
    built = index.build(spark.createDataFrame(entries(3), SCHEMA))
    first = store.save(built, str(folder), generated_at="t")
    again = store.save(index.build(spark.createDataFrame(entries(3)[::-1], SCHEMA).repartition(3)), str(folder), generated_at="t")
    assert first == again and len(tables()) == 6  # same content, same names
    raw = (folder / "manifest.json").read_text()
    assert raw == json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"))
    other = store.save(index.build(spark.createDataFrame(entries(4), SCHEMA)), str(folder), clean_up=True)
    assert tables() == sorted(["manifest.json", *(t["path"] for t in other["tables"].values())])
    assert all(f.name.endswith(".zstd.parquet") for f in folder.rglob("*.parquet"))
    spark.read.parquet(str(folder / other["tables"]["docs"]["path"])).limit(1).write.mode("append").parquet(str(folder / other["tables"]["docs"]["path"]))
    with pytest.raises(ValueError, match="docs has"):
        store.load(spark, str(folder))
    twice = index.build(spark.createDataFrame([*entries(3), entries(3)[1]], SCHEMA))
    with pytest.raises(ValueError, match="come twice"):
        store.save(twice, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="come twice"):
        index.check_ids(spark.range(0, 3))
    with pytest.raises(ValueError, match="keys"):
        index.check_grams(spark.createDataFrame([("ab",), ("ab",)], "gram string"))
    json_text = (folder / "manifest.json").read_text().replace('"version":2', '"version":9')
    (folder / "manifest.json").write_text(json_text)
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="version 9"):
        store.load(spark, str(folder))


def test_latest_request_wins(spark):
    """A search that runs is interrupted by the next one."""
    catalog = index.build(spark.createDataFrame(entries(3), SCHEMA)).cached()
    slow = F.udf(lambda g: time.sleep(0.5) or g, "string")
    searcher, failed = Searcher(Catalog(catalog.docs, catalog.tags, catalog.authors, catalog.postings, catalog.grams.select(slow("gram").alias("gram")))), []

    def first():
        try:
            searcher.search(Request(q="abcd"))
        except Superseded as e:
            failed.append(e)

    t = threading.Thread(target=first)
    t.start()
    time.sleep(2)
    searcher.catalog = catalog
    assert searcher.search(Request(lock="only0")).count() > 0
    t.join(60)
    assert len(failed) == 1 and not t.is_alive()
    catalog.release()


def test_command_line(spark, tmp_path):
    """An SQLite file to a saved catalogue."""
    db = tmp_path / "s.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE comics (id INTEGER, json TEXT)")
        c.executemany("INSERT INTO comics VALUES (?, ?)", [(k, json.dumps({"id": k, "title": f"ring {k} \U00020000x"})) for k in range(1, 30)] + [(40, None), (41, "{")])
    c.close()
    raw = sqlite.read(spark, str(db), parts=3)
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 31
    assert main([str(db), "--out-dir", str(tmp_path / "c"), "--clean", "--index-shard-count", "3", "--generated-at", "2026-02-01"]) == 0
    m = json.loads((tmp_path / "c/manifest.json").read_text())
    assert (m["generated_at"], m["shards"], m["stats"]["count"], m["stats"]["skipped"]) == ("2026-02-01", 3, 29, 29 + 29)
    found = search(store.load(spark, str(tmp_path / "c")), Request(q="ring"))
    assert found.first().total == 29
    with pytest.raises(sqlite3.OperationalError):
        sqlite.read(spark, str(tmp_path / "none.sqlite"))


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    catalog = index.build(empty)
    assert search(catalog, Request(q="ab")).count() == 0 and search(catalog, Request(lock="only0")).count() == 0


def test_can_read(spark):
    docs = [(k, f'{{"id":{k},"canRead":{v},"is_need_login":1}}') for k, v in enumerate(("true", '" YES "', '"n"', "0", "null", '"?"', "1.5"))]
    got = json_documents.parse(spark.createDataFrame(docs, "id long, json string")).orderBy("id").collect()
    assert [r.need_login for r in got] == [False, False, True, True, True, True, False]
    wide = spark.createDataFrame([(1, '{"id":1,"authors":[{"tag_id":70000,"tag_name":""}]}')], "id long, json string")
    assert json_documents.parse(wide).first().authors == []
    with pytest.raises(Exception, match="not within 0 and 65535"):
        json_documents.parse(wide, largest_author=65535).collect()
    broken = json_documents.parse(spark.createDataFrame([(1, "{"), (2, None), (3, '{"id":true}')], "id long, json string"))
    assert sorted((r.src_id, r.id) for r in broken.collect() if r.id is not None) == [(3, 1)]


def test_refresh(spark, tmp_path):
    from lexiquarry.streaming.refresh import refresh

    source, folder = str(tmp_path / "in"), str(tmp_path / "c")
    for rows, want in (([(1, "red ring"), (2, "bolt")], [1]), ([(2, "ring bolt"), (3, "a ring")], [3, 2, 1])):
        spark.createDataFrame([(k, json.dumps({"id": k, "title": t})) for k, t in rows], "id long, json string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, json string").parquet(source)
        refresh(stream, str(tmp_path / "state"), folder, str(tmp_path / "ck")).awaitTermination()
        assert [r.id for r in search(store.load(spark, folder), Request(q="ring", sort="id_desc")).orderBy("rank").collect()] == want
