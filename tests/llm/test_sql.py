"""The registered queries against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

from tilewright.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(name, spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(str(r[have.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op1_language_id", "op4_toxicity"])
def test_every_document_is_predicted(name, spark):
    df = registry.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == n and df.where("score BETWEEN 0 AND 1").count() == n
