"""What a query works out more often than it needs to."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ctxspark.operators import bm25, budget, chunker, vector, vector_lists


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packing_counts_words_once(spark):
    """Token estimates of the text and of its lines, and the fold over lines, stand once each in the plan, whatever uses them."""
    docs = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    packed = docs.select(budget.pack_text("text", 1).alias("p")).select(F.col("p.tokens"), F.md5("p.text"))
    assert plan_of(packed).count("aggregate(") <= 3


def test_tasks_hold_bounded_slices(monkeypatch):
    """Frames of any size are taken in slices: visits of lists, scores, declarations."""
    vectors = [np.array([1.0, i]) for i in range(50)]
    lists = vector_lists.Lists(None, [[1.0, 0.0]] * 40, {n: (5, 0.0, 1.6) for n in range(40)}, "vec_id", "embedding")
    visits = vector_lists._visits(lists, 10, True)
    frame = pd.DataFrame({"query_id": range(50), "q": vectors, "floor": [np.nan] * 50})
    whole = pd.concat(visits(iter([frame])))
    monkeypatch.setattr(vector_lists, "VISITS", 100)
    parts = list(visits(iter([frame])))
    assert max(map(len, parts)) < 100 + 40 and len(parts) > 10
    pd.testing.assert_frame_equal(pd.concat(parts).reset_index(drop=True), whole.reset_index(drop=True))

    monkeypatch.setattr(chunker, "SLICE", 8)
    sources = pd.DataFrame({"path": [f"{i}.ts" for i in range(50)], "code": ["function f() {}"] * 50})
    assert [len(x) for x in chunker._chunker(False)(iter([sources]))] == [8] * 6 + [2]

    seen = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *rest, **more: seen.append(x.shape) or partition(x, *rest, **more))
    monkeypatch.setattr(vector, "SLICE", 8)
    held = SimpleNamespace(value=([0, 1], [np.array([1.0, 0.0]), np.array([0.0, 1.0])]))
    best = pd.concat(vector._best(held, 3, "vec_id", "embedding")(iter([pd.DataFrame({"vec_id": range(50), "embedding": vectors})])))
    assert max(columns for _, columns in seen) <= 8
    assert best.groupby("query_id")["vec_id"].apply(list).to_dict() == {0: [0, 1, 2], 1: [49, 48, 47]}


def test_terms_are_counted_once(spark):
    """The starts of equal terms are found once, and terms aren't sorted by a lambda."""
    docs = spark.createDataFrame([(1, "b a b")], "id long, text string").select("id", F.split("text", " ").alias("tokens"))
    posted = bm25.postings(docs)
    plan = plan_of(posted)
    assert plan.count("sequence(") == 1 and "array_sort" not in plan
    assert sorted((x["term"], x["tf"], x["dl"]) for x in posted.collect()) == [("a", 1, 3), ("b", 2, 3)]
