"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trellis import suite

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(value):
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return ("n", round(float(value), 6))
    return ("s", str(value))


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = suite.QUERIES[name](spark, DATA)
    expected = sql.sql(suite.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    ours = sorted(tuple(key(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(key(dict(zip(expected.columns, r, strict=True))[c]) for c in columns) for r in expected.fetchall())
    assert ours == theirs
