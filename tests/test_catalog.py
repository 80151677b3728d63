"""Queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

from strataflow.plans import catalog

DATA = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return con


def plain(rows):
    return sorted(tuple("" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_patch_synthesis_covers_every_frame(spark):
    got = catalog.QUERIES["patch_synthesis"](spark, DATA)
    assert got.count() == catalog.px(spark, DATA).count() and got.select("t").distinct().count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
