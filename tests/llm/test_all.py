"""All queries on empty tables, and their SQL twins on the smallest given tables."""

import os

import duckdb
import pytest

from pagewright import llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nothing(tables):
    return tables()


@pytest.mark.parametrize("name", list(llm.queries()))
def test_empty_tables(spark, nothing, name):
    assert llm.queries()[name](spark, nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_twins(spark, name):
    df = llm.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    c = duckdb.connect(config={"memory_limit": "2GB"})
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    twin = c.sql(llm.oracle_sql()[name])
    at = [twin.columns.index(x) for x in columns]
    assert sorted(tuple(map(str, (r[x] for x in columns))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in twin.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in llm.queries() if n not in llm.oracle_sql()])
def test_given_tables(spark, name):
    df = llm.queries()[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
