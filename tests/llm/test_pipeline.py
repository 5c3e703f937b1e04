"""run() against the stages redone by brute force."""

import collections
import math
import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ctxspark.llm import bpe, common, mixing, substring
from tests.llm.test_operators import WORD, alike_by_force, counts_by_force

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rejected(rows):
    """Stage 1: who breaks the base rule, or another one on a host that is bad for it."""
    broken = []
    for r in rows:
        words, chars, symbols, dups, repeated = counts_by_force(r["text"])
        lines = sum(bool(WORD.search(x)) for x in r["text"].split("\n"))
        broken.append((words < 10 or 100 * repeated > 20 * words, symbols > 0.1 * words, dups > 0.3 * lines, chars < 2.5 * words or chars > 14 * words))
    judged = [(r["source"], b) for r, b in zip(rows, broken) if not b[0]]
    n = collections.Counter(host for host, _ in judged)
    fails = [collections.Counter(host for host, b in judged if b[rule]) for rule in range(4)]
    bad = set()
    for rule in range(1, 4):
        mean = sum(fails[rule].values()) / len(judged)
        spread = np.var([fails[rule][h] / n[h] for h in n])
        strength = min(1000, max(1, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000
        for h in n:
            rate = (fails[rule][h] + strength * mean) / (n[h] + strength)
            if rate >= 0.5 or rate - mean > 0.8416 * math.sqrt(rate * (1 - rate) / (n[h] + strength + 1)):
                bad.add((h, rule))
    return [b[0] or any(b[k] and (r["source"], k) in bad for k in (1, 2, 3)) for r, b in zip(rows, broken)]


def cut(rows, window=substring.WINDOW):
    """Stage 3: texts without words of repeated windows."""
    words = [WORD.findall(r["text"]) for r in rows]
    counts = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        if any(gone):
            at, parts, begin = [m.span() for m in WORD.finditer(r["text"])], [], None
            for i, g in enumerate([*gone, True]):
                if not g and begin is None:
                    begin = i
                if g and begin is not None:
                    parts.append(r["text"][at[begin][0] : at[i - 1][1]])
                    begin = None
            r = r | {"text": " ".join(parts), "n_chars": len(" ".join(parts))}
        yield r


@pytest.fixture(scope="module")
def expected(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r, no in zip(rows, rejected(rows)) if not no]
    kept = {i for i, least in alike_by_force([(r["doc_id"], r["text"]) for r in rows]) if i == least}
    return list(cut([r for r in rows if r["doc_id"] in kept]))


def test_run_is_brute_force(spark, expected, tmp_path):
    import pandas as pd
    import public_tokenizers
    import tiktoken

    documents = pd.DataFrame(expected)  # noqa: F841  read by DuckDB
    passes = duckdb.connect().sql(mixing.OP3_SQL).fetchall()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in expected}
    rows = []
    for doc_id, *_ in passes:
        ids = own.encode_ordinary(texts[doc_id])
        rows.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[doc_id].encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(rows)


def test_quality_rules_cut_no_texts(spark, hard_docs, monkeypatch):
    """A copy of all texts would stay on disk while the second stage runs; and counting them again costs one call a row, not two."""
    cut, columns = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df: columns.append(df.columns) or cut(df))
    found = corpus_pipeline.keep_good(spark, spark.createDataFrame(*hard_docs), SF)
    assert columns and not any("text" in x for x in columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in found.collect()} == {None, 1, 8}


def test_stages_write_and_read(spark, hard_docs, tmp_path):
    """Each stage's rows as Parquet are the next one's documents; hard rows and other columns get through."""
    rows, schema = hard_docs
    docs = spark.createDataFrame(rows, schema)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(os.path.join(tmp_path, str(i)))
        docs = spark.read.parquet(os.path.join(tmp_path, str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    found = {r["doc_id"] for r in docs.collect()}
    assert {None, 1, 7}.intersection(found) and 2 not in found and 5 not in found


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
