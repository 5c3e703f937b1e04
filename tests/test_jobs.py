"""The jobs: runs over growing input, reruns, hard rows, command lines, and their queries against DuckDB."""

import collections
import math
import os
import subprocess
import sys

import duckdb
import pytest

from ctxspark.functions.text import tokenize
from ctxspark.operators import bm25
from jobs import common, context_packs, registry, term_index

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS FROM '{DATA}/{table}.parquet'")
    found, expected = registry.queries()[name](spark, DATA), con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in order) for r in expected.fetchall())


def put(spark, rows, folder, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def expected_postings(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", tokenize("text").alias("t")).collect()
    return {(r["doc_id"], term): (n, len(r["t"])) for r in rows for term, n in collections.Counter(r["t"]).items()}


def found_postings(rows):
    out = {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in rows.collect()}
    assert len(out) == rows.count()
    return out


@pytest.fixture
def index(tmp_path):
    return {"source": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def test_term_index_grows(spark, index):
    """Each run takes what is new; a document that comes again replaces its older version."""
    put(spark, [(1, "alpha beta beta", "en", "a", 1), (2, "getUserName gamma", "en", "b", 1)], index["source"])
    first = found_postings(term_index.run(spark, **index))
    assert first == expected_postings(spark, {1: "alpha beta beta", 2: "getUserName gamma"})
    put(spark, [(2, "delta", "en", "b", 1), (3, None, None, None, None), (None, "lost", "en", "a", 1), (4, "", "en", "a", 0)], index["source"])
    second = found_postings(term_index.run(spark, **index))
    assert second == expected_postings(spark, {1: "alpha beta beta", 2: "delta"})
    assert found_postings(term_index.run(spark, **index)) == second
    batches = {r["batch"] for r in spark.read.parquet(index["output"] + "/documents").select("batch").distinct().collect()}
    assert len(batches) == 2  # the third run had nothing to read
    counts = term_index.statistics(spark, index["output"]).first()
    assert (counts["n"], counts["mean"]) == (4, 1.0)


def test_term_index_from_nothing_and_from_parts_is_the_same(spark, index, tmp_path):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    for part in range(3):
        rows.where(f"doc_id % 3 = {part}").coalesce(1).write.mode("append").parquet(index["source"])
        grown = term_index.run(spark, **index)
    whole = term_index.run(spark, index["source"], str(tmp_path / "out2"), str(tmp_path / "mark2"), files_per_batch=2)
    assert found_postings(grown) == found_postings(whole)
    question = "ontion heea"
    terms = bm25.query_tokens(spark, question)
    own = rows.select("doc_id", tokenize("text").alias("tokens"))
    scores = own.select("doc_id", bm25.bm25(terms, bm25.statistics(own, terms)).alias("score")).where("score > 0").collect()
    best = sorted(((-round(r["score"], 9), r["doc_id"]) for r in scores))[:10]
    assert [(-round(r["score"], 9), r["doc_id"]) for r in term_index.ask(spark, index["output"], question).collect()] == best


def test_term_index_of_nothing_yet(spark, index):
    """A folder without files, then one with other columns, some of them called like the job's own."""
    os.mkdir(index["source"])
    assert term_index.run(spark, **index).collect() == [] and term_index.statistics(spark, index["output"]).first()["n"] == 0
    put(spark, [(1, "alpha beta", "en", "a", 7, "x", 3)], index["source"], DOCS.replace("n_chars", "batch") + ", bucket string, dl int")
    assert found_postings(term_index.run(spark, **index)) == {(1, "alpha"): (1, 2), (1, "beta"): (1, 2)}


def test_context_packs_of_nothing(spark, tmp_path):
    put(spark, [], str(tmp_path / "docs"))
    put(spark, [(1, "alpha")], str(tmp_path / "asked"), "item_id long, text string")
    put(spark, [(1, "alpha", "en", "a", 1)], str(tmp_path / "some"))
    put(spark, [], str(tmp_path / "none"), "item_id long, text string")
    for docs, asked in (("docs", "asked"), ("some", "none"), ("docs", "none")):
        assert context_packs.run(spark, str(tmp_path / docs), str(tmp_path / asked), str(tmp_path / "out")).collect() == []


def test_term_index_batch_again(spark, index):
    """A batch that runs twice, as after a failure between its two writes, leaves the rows of one run."""
    from pyspark.sql import functions as F

    put(spark, [(1, "alpha beta", "en", "a", 1), (1, "alpha beta", "en", "a", 1)], index["source"])
    batch = spark.read.parquet(index["source"]).select(*term_index.COLUMNS, F.current_timestamp().alias("changed"), F.lit("f").alias("file"))
    add = term_index._adder(index["output"], 4)
    add(batch, 0)
    add(batch, 0)
    assert found_postings(term_index.current(spark, index["output"])) == {(1, "alpha"): (1, 2), (1, "beta"): (1, 2)}


def test_context_packs_by_force(spark, tmp_path):
    """Scores, ranks and budget of several questions, with nulls, ties and a question that nothing answers."""
    docs = [(i, f"alpha {'beta ' * (i % 3)}word{i % 5}\nmore text {i}", "en", f"s{i}", 1) for i in range(40)] + [(None, "alpha", "en", "s", 1), (90, None, None, None, None), (91, "alpha", None, None, 1)]
    put(spark, docs, str(tmp_path / "docs"))
    put(spark, [(1, "beta word3 beta"), (2, "nothing here"), (3, "alpha"), (None, "alpha"), (4, None)], str(tmp_path / "asked"), "item_id long, text string")
    paths = [str(tmp_path / x) for x in ("docs", "asked", "out")]
    first = sorted(map(tuple, context_packs.run(spark, *paths, top=7, budget=60).collect()))
    assert sorted(map(tuple, context_packs.run(spark, *paths, top=7, budget=60).collect())) == first
    words = {i: [w for w in (t or "").split() if len(w) > 1 and w != "more"] for i, t, *_ in docs if i is not None}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    for question, terms in ((1, ["beta", "word3", "beta"]), (3, ["alpha"])):
        score = collections.Counter()
        for term in terms:
            df = sum(term in w for w in words.values())
            for i, w in words.items():
                tf = w.count(term)
                score[i] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted((-round(s, 9), i) for i, s in score.items() if s)[:7]
        own = [r for r in first if r[0] == question]
        assert [(r[2], r[3]) for r in own] == [(i, round(-s, 6)) for s, i in best][: len(own)]
        assert 0 < len(own) and own[-1][6] <= 60
    assert {r[0] for r in first} == {1, 3}


def test_settings_over_config(tmp_path):
    config = tmp_path / "c.toml"
    config.write_text('source = "a"\noutput = "b"\nbuckets = 3\n')
    assert common.settings("", ["source", "output"], [str(config), "--output", "c"]) == {"source": "a", "output": "c", "buckets": 3}


def test_command_line(spark, index, tmp_path):
    put(spark, [(1, "alpha beta", "en", "a", 1)], index["source"])
    config = tmp_path / "c.toml"
    config.write_text("".join(f'{k} = "{v}"\n' for k, v in index.items()) + "buckets = 2\n")
    done = subprocess.run(
        [sys.executable, "-m", "jobs.term_index", str(config)], cwd=ROOT, capture_output=True, text=True, timeout=240,
        env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.driver.host=127.0.0.1 pyspark-shell"},
    )
    assert done.returncode == 0, done.stderr
    assert "wrote 1 documents" in done.stderr
    assert found_postings(term_index.current(spark, index["output"])) == {(1, "alpha"): (1, 2), (1, "beta"): (1, 2)}
