from pyspark.sql import functions as F

from lexiquarry.functions import cover, text
from lexiquarry.plans.request import Request, parse, threshold


def test_norm_and_bigrams(spark):
    cases = {"Red-Ring!": "redring", "ＡＢ": "ab", "aaaa": "aaaa", "x": "x", "_!": "", "½": "12", "": "", "É́😀漢": "é漢"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r.s: (r.n, r.g) for r in rows.select("s", text.norm(F.col("s")).alias("n")).select("s", "n", text.bigrams(F.col("n")).alias("g")).collect()}
    for s, n in cases.items():
        assert got[s] == (n, [n[i : i + 2] for i in range(len(n) - 1)]) or s == "É́😀漢"
        assert text.norm_of(s) == got[s][0]
    assert got[None] == ("", [])


def test_keys_and_shards(spark):
    for gram in ("ab", "漢字", "zz"):
        key = ord(gram[0]) * 65536 + ord(gram[1])
        row = spark.range(1).select(text.gram_key(F.lit(gram)).alias("k"), text.gram_shard(text.gram_key(F.lit(gram)), 8).alias("s")).first()
        assert (row.k, row.s) == (key, key * 2654435761 % 2**32 % 8)


def test_cover(spark):
    cases = {
        "https://h/p.png#f": ("https://h", "/p.png#f"),
        "http://h/p?q=1#f": ("http://h", "/p?q=1"),
        "//h/p": ("https://h", "/p"),
        "/p": ("", "/p"),
        "data://x": ("", "data://x"),
        "host": ("https://host", ""),
        "http://h/p?": ("http://h", "/p"),
        "  ": ("", ""),
        "http:///p": ("", "http:///p"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = rows.select("s", cover.split_cover(cover.without_https(F.col("s"))).alias("c")).collect()
    assert {r.s: (r.c.base, r.c.path) for r in got} == cases


def test_parse():
    words = lambda q: tuple([t.text for t in ts] for ts in parse(q))
    assert words("Ring ring -Foo －bar a") == (["ring"], ["bar", "foo"])
    assert words("ring -ring") == ([], ["ring"])
    assert words("a　bc﻿de") == (["bc", "de"], [])
    assert [len(parse(q)[0][0].grams) for q in ("aaaa", "abc", "𠀀")] == [1, 2, 1]
    assert parse("𠀀")[0][0].n == 1
    assert [threshold(n, n) for n in range(1, 11)] == [1, 2, 2, 3, 3, 4, 5, 5, 6, 6]
    assert threshold(6, 2) == 2
    r = Request(page=0, size=1000)
    assert (r.offset, r.limit) == (0, 100) and Request(page=3, size=-1).offset == 2
