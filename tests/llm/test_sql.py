"""Operators that SQL can express give DuckDB's rows on whole tables."""

import glob
import os

import duckdb
import pytest

from leafmark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, result = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(result.columns)
    columns = sorted(got.columns)
    want = [tuple(r[result.columns.index(c)] for c in columns) for r in result.fetchall()]
    assert want and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
