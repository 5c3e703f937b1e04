"""Inverted lists against all pairs: clusters, uniform vectors, ties, hard rows, lists and queries in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.operators import vector, vector_lists


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def by_force(rows, queries, k):
    def cosine(a, b):
        ok = lambda v: v is not None and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)
        if not ok(a) or not ok(b):
            return 0.0
        a, b = (np.array(x, float) / np.abs(np.array(x, float)).max() for x in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    for qid, q in queries:
        scores = sorted((-round(cosine(q, v), 9), i) for i, v in rows)[:k]
        yield from ((qid, i, -s, n + 1) for n, (s, i) in enumerate(scores))


def same(found, expected):
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9) + 0.0) for r in found.collect())
    assert found == sorted((q, n, i, s + 0.0) for q, i, s, n in expected)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    centers = r.normal(size=(12, 6)) * 3
    own = [(i, (centers[i % 12] + r.normal(size=6) * 0.2).tolist()) for i in range(600)]
    return own + [(1000 + i, own[0][1]) for i in range(15)] + [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0] * 5), (2004, [1.0, None, 0, 0, 0, 0]), (2005, [float("inf")] * 6), (2006, [1e200] * 6), (2007, [-1e-200] * 6)]


def test_lists_find_what_all_pairs_do(spark, rows, monkeypatch):
    vectors = frame(spark, rows)
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] >= 2000]
    lists = vector_lists.build(vectors, 20)
    assert sum(v[0] for v in lists.sizes.values()) == len(rows) and lists.sizes[vector_lists.NOWHERE][0] == 6
    for k in (1, 10, 30):
        same(vector_lists.search(lists, frame(spark, queries), k), by_force(rows, queries, k))
    clustered = [q for q in queries if q[0] < 2000]
    assert vector_lists.share_read(lists, frame(spark, clustered), 10) < 0.3
    monkeypatch.setattr(vector_lists, "BLOCK", 7)
    monkeypatch.setattr(vector_lists, "QUERIES", 5)
    same(vector_lists.search(vector_lists.build(vectors, 3), frame(spark, [*queries, (None, [1.0] * 6)]), 10), by_force(rows, queries, 10))


def test_few_and_no_vectors(spark, rows):
    few, none = rows[:4], frame(spark, [])
    same(vector_lists.search(vector_lists.build(frame(spark, few)), frame(spark, few), 10), by_force(few, few, 10))
    assert vector_lists.search(vector_lists.build(none), frame(spark, few), 3).collect() == []
    assert vector_lists.search(vector_lists.build(frame(spark, few)), none, 3).collect() == []
    nowhere = [(1, None), (2, [0.0] * 6)]
    same(vector_lists.search(vector_lists.build(frame(spark, nowhere)), frame(spark, few), 1), by_force(nowhere, few, 1))


def test_given_vectors(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = own.where("vec_id % 100 = 0")
    found = vector_lists.search(vector_lists.build(own), queries, 10).select("query_id", "vec_id", F.round("score", 9).alias("s"))
    expected = vector.search_all(queries, own, 10).select("query_id", "vec_id", F.round("score", 9).alias("s"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
