"""Operators that SQL can express against DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from ctxspark.llm import registry

DATA = "/root/testdata/sf0.001"


def same(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) and not math.isnan(x) else repr(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, expected = registry.queries()[name](spark, DATA), con.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted("|".join(same(r[c]) for c in columns) for r in found.collect()) == sorted("|".join(same(r[i]) for i in order) for r in expected.fetchall())
