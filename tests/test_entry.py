"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from genoloom.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert key(a) == key(b)


def test_rows_only_queries(spark):
    n = queries.demo.variants(spark, DATA).count()
    assert 0 < queries.sample_stratified(spark, DATA).count() < n
    assert queries.gene_indel_hgvs(spark, DATA).filter("change like '%del%'").count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
