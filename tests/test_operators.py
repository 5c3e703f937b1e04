"""Formulas restated as loops, golden values, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as tx
from ctxspark.operators import bm25, budget, chunker, graph, hybrid, recency, vector


def test_bm25_golden(spark):
    docs = spark.createDataFrame([("D1", "login user"), ("D2", "logout")], "id string, text string").withColumn("tokens", tx.tokenize("text"))
    terms = bm25.query_tokens(spark, "login")
    found = {r["id"]: r["s"] for r in docs.select("id", bm25.bm25(terms, bm25.statistics(docs, terms)).alias("s")).collect()}
    assert found["D1"] == pytest.approx(math.log(2) * 2.2 / 2.5) and found["D2"] == 0


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "id string, tokens array<string>")
    stats = bm25.statistics(docs, ["a"])
    assert stats["n"] == 0 and docs.select(bm25.bm25(["a"], stats)).collect() == []


def test_estimate_tokens_golden(spark):
    cases = {"": 0, "   ": 1, "a bb ccccc": 4, "getUserSessionDetails(x)": 4, "  a/b.ts: f(x)\n": 4, "line one\nline two\n\nend": 7}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.estimate_tokens("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


def loop_pagerank(edges, nodes, damping=0.85, steps=20):
    out = {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(steps):
        rank = {n: (1 - damping) / len(nodes) + damping * sum(rank[a] / out[a] for a, b in edges if b == n) for n in nodes}
    return rank


@pytest.mark.parametrize("ranked", [graph.pagerank, graph.pagerank_by_joins])
def test_pagerank_is_the_loop(spark, ranked):
    r = random.Random(3)
    edges = list({(f"f{r.randint(0, 9)}", f"f{r.randint(0, 9)}") for _ in range(25)})
    nodes = sorted({x for e in edges for x in e})
    found = {x["file"]: x["rank"] for x in ranked(spark.createDataFrame(edges, "source_file string, target_file string")).collect()}
    expected = loop_pagerank(edges, nodes)
    assert found.keys() == expected.keys() and all(found[n] == pytest.approx(expected[n], abs=1e-12) for n in nodes)
    assert min(found.values()) >= 0.15 / len(nodes) - 1e-12


def test_pagerank_of_nothing(spark):
    empty = spark.createDataFrame([], "source_file string, target_file string")
    assert graph.pagerank(empty).collect() == []


def test_recency_is_decay(spark):
    row = spark.range(1).select(recency.decay(F.lit(7 * 86400.0)).alias("w"), recency.decay(F.lit(30 * 86400.0)).alias("m")).first()
    assert row["w"] == pytest.approx(0.4966, abs=1e-4) and row["m"] == pytest.approx(0.0498, abs=1e-4)


def test_first_commit_in_log_order_wins(spark):
    commits = spark.createDataFrame([("a.ts", 10, 1), ("a.ts", 99, 2)], "path string, ts long, commit_ord int")
    assert recency.latest_per_file(commits.withColumn("ts", F.timestamp_seconds("ts"))).select(F.unix_seconds("ts")).first()[0] == 10


def test_cosine_bounds(spark):
    r = random.Random(1)
    rows = [([r.gauss(0, 1) for _ in range(8)], [r.gauss(0, 1) for _ in range(8)]) for _ in range(50)]
    found = spark.createDataFrame(rows, "a array<double>, b array<double>").select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    for (a, b), row in zip(rows, found):
        expected = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))
        assert row["c"] == pytest.approx(expected) and -1 <= row["c"] <= 1


def test_search_all_in_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = vector.search_all(vectors.where("vec_id < 20"), vectors, 5).collect()
    parts = vector.search_all(vectors.where("vec_id < 20"), vectors, 5, block=7).collect()
    key = lambda x: (x["query_id"], x["rank"], x["vec_id"])
    assert sorted(map(key, whole)) == sorted(map(key, parts)) and len(whole) == 100


def test_search_all_hard_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [float("inf"), 1.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector.search_all(vectors.where("vec_id = 1 or vec_id is null"), vectors.where("vec_id is not null"), 3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]


def test_term_counts_are_counts(spark):
    r = random.Random(4)
    rows = [(i, [r.choice("abcdefg") for _ in range(r.randint(0, 30))]) for i in range(40)] + [(40, []), (41, None), (42, ["x"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    found = {(p["id"], p["term"]): (p["tf"], p["dl"]) for p in bm25.postings(docs).collect()}
    assert found == {(i, t): (tokens.count(t), len(tokens)) for i, tokens in rows for t in tokens or []}


def test_prefix_is_the_loop(spark):
    r = random.Random(5)
    costs = [(i, r.randint(1, 30)) for i in range(40)]
    expected, used = [], 0
    for i, c in costs:
        if used + c > 200:
            break
        used += c
        expected.append(i)
    rows = spark.createDataFrame(costs, "i int, cost int")
    assert sorted(x["i"] for x in budget.prefix(rows, "cost", 200, ["i"]).collect()) == expected


def test_greedy_stays_within_budget(spark):
    r = random.Random(6)
    rows = [(str(i), "word " * r.randint(1, 40), r.random(), r.choice(["graph", "search"])) for i in range(50)]
    found = budget.pack_greedy(spark.createDataFrame(rows, "id string, text string, score double, source string"), 100).first()
    assert found["total_tokens"] <= 100 and len(found["kept"]) + found["dropped"] == 50


def test_token_budget_follows_the_table():
    assert budget.token_budget(None) == 4000 and budget.token_budget("GPT-4o") == 6000 and budget.token_budget("o3-mini") == 10000


def test_search_checks_k(spark):
    chunks = spark.createDataFrame([("a#x", "a", "x", "", "")], "id string, file string, name string, signature string, summary string")
    with pytest.raises(ValueError):
        hybrid.search(chunks, "x", "many")
    assert hybrid.search(chunks, "zebra", 0).collect() == []


def test_scanner_steps_over_strings():
    text = "const a = '}'; const b = `x${ { y: '`' }.y }`; /* } */ function f() { return /[/}]/ }\n"
    assert [s[4] for s in chunker.statements(text)] == ["const", "const", "function"]


def test_chunks_keep_comments_and_hashes():
    rows = chunker.chunks_of("a.ts", "/** Doc. */\nexport function f() {}\n")
    assert rows[0][5] == "/** Doc. */\nexport function f() {}" and rows[0][2] == "a.ts#f" and len(rows[0][6]) == 32


def test_broken_sources_end():
    for text in ("function f( {", "class A { x(", "const a = `", "/* ", "'", "}}}", "export", "class {", "\\", "const = ;"):
        chunker.chunks_of("a.ts", text)


def test_paths_by_equal_ends(spark):
    """Matches of files and committed paths by brute force; a third of the files are called index.ts; no nested loop in the plan."""
    import random

    from ctxspark.functions import paths
    from ctxspark.operators import context, recency

    r = random.Random(3)
    name = lambda n: "/".join(r.choice(["a", "ba", "c.ts", "xc.ts", "d"]) for _ in range(n))
    files = sorted({name(r.randint(1, 4)) for _ in range(120)} | {f"{name(r.randint(1, 3))}/index.ts" for _ in range(60)})
    log = [(name(r.randint(1, 4)), i, i / 100) for i in range(60)] + [("index.ts", 60, 0.5), ("a/index.ts", 61, 0.4), ("", 99, 0.1)]
    frame = spark.createDataFrame([(f,) for f in files], "file string")
    recent = spark.createDataFrame(log, "path string, commit_ord int, recency double")
    short = lambda f: "/".join(f.split("/")[-2:])
    expected = {f: next(x for p, _, x in log if f.endswith(p) or p.endswith(short(f))) for f in files}
    found = recency.match_files(frame, recent)
    assert {x["file"]: x["recency"] for x in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    pairs = paths.ending_pairs(frame, "file", recent.select("path"), "path").collect()
    assert sorted(map(tuple, pairs)) == sorted((f, p) for f in files for p, *_ in log if f.endswith(p))
    assert paths.ending_pairs(frame, "file", recent.select("path").limit(0), "path").collect() == []
    changed = [p for p, _, _ in log[:5]]
    found = {x["file"] for x in context.changed_chunks(frame, spark.createDataFrame([(p,) for p in changed], "path string")).collect()}
    assert found == {f for f in files if any(f.endswith(p) or p.endswith(f) for p in changed)}
