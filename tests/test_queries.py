"""Every catalogue query runs on the smallest tables and agrees with its SQL in DuckDB."""

import os

import duckdb
import pytest

from veilspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def flat(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(flat(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want
