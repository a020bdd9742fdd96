"""Every query of the catalogue against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tilewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    try:
        return f"{float(v):.8g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_its_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    want = sorted(tuple(plain(r[have.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0
