"""Queries against their SQL, on the smallest tables and on odd texts."""

import os

import duckdb
import pytest

from genoloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, docs, texts, tmp_path_factory):
    """A folder of tables: the shared odd texts, one row per id, and pages that hold them, some under one payload."""
    where = str(tmp_path_factory.mktemp("odd"))
    docs.dropDuplicates(["doc_id"]).write.parquet(f"{where}/documents.parquet")
    urls = ["http://www.a.example.com", "https://b.example.org/x/y?z=1#t", "http://C.example.net:8080/?", "https://d.example.com/p#f?g"]
    pages = [(i, urls[i % 4], texts[i % len(texts)]) for i in range(2 * len(texts))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


def same(spark, name, folder):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        files = f"{folder}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{folder}/{t}.parquet") else "")
        c.execute(f"create view {t} as select * from '{files}'")
    found = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = registry.queries()[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_odd_texts(spark, odd, name):
    same(spark, name, odd)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_smallest_tables(spark, name):
    same(spark, name, DATA)
