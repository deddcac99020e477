"""Each registered query runs over whole small tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from veilspark.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
TABLE = {"op6_embedding_forest": "embeddings", "op10_url_gbt": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    n = spark.read.parquet(f"{DATA}/{TABLE.get(name, 'documents')}.parquet").count()
    assert len(rows) == n + (spark.read.parquet(f"{DATA}/pages.parquet").count() if name.startswith("op5") else 0)
    if name in oracles.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        rel = con.sql(oracles.ORACLES[name])
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
