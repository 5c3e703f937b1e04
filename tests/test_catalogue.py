"""Every catalogue query against DuckDB on the smallest tables, whole rows compared."""

import glob
import math
import os

import duckdb
import pytest

from ctxspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def same(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(same, x)) + "]"
    return repr(x)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, oracle, name):
    found = catalogue.queries()[name](spark, DATA)
    expected = oracle.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = sorted("|".join(same(r[c]) for c in sorted(found.columns)) for r in found.collect())
    order = [expected.columns.index(c) for c in sorted(expected.columns)]
    assert rows == sorted("|".join(same(r[i]) for i in order) for r in expected.fetchall())
