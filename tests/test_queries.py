"""Every query of the core runs over the smallest tables; where it has a SQL twin, DuckDB gives the same rows."""

import math
import os

import duckdb
import pytest

from pagewright import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect(config={"memory_limit": "2GB"})
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "as_tuple"):
        return repr(float(f"{float(v):.9g}"))
    return str(v)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.toArrow().to_pylist())
    sql = plans.oracle_sql().get(name)
    if sql:
        twin = db.sql(sql)
        assert sorted(twin.columns) == columns
        at = [twin.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in twin.fetchall())


def test_every_twin_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
