"""Every query of the engine against its SQL."""

import os

import duckdb
import pytest

from lexiquarry import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.FOUND))
def test_query(spark, oracle, name):
    run, sql = queries.FOUND[name]
    df, want = run(spark, FOLDER), oracle.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_batch_follows_search(spark):
    requests = [(k, q) for k, q in enumerate(("brand#13", "-ring", "-zzqqxx", "-ring -brand#1", ""))]
    catalog = queries._part_catalog(spark, FOLDER)
    got = queries.batch.search_many(catalog, spark.createDataFrame(requests, "request_id long, q string"))
    want = [(k, *r) for k, q in requests for r in queries.search.search(catalog, queries.Request(q=q)).select("rank", "id", "score", "total", "has_more").collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {k for k, *_ in want} == {0, 1, 2}
    with pytest.raises(Exception, match="mode or sort"):
        queries.batch.search_many(catalog, spark.createDataFrame([(1, "ring", "random")], "request_id long, q string, sort string")).collect()
    with pytest.raises(ValueError):
        queries.batch.search_many(catalog, spark.createDataFrame(requests, "request_id long, q string"), together=2)
