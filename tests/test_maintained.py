"""Postings, graph and ranks that are kept up to date: always what a fresh build has."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.functions.text import tokenize
from ctxspark.operators import chunker, graph, hybrid, maintained, postings
from ctxspark.plans import index as plans
from ctxspark.plans.index import Index
from ctxspark.sources import files as scanning
from ctxspark.sources import versions


def edge_rows(spark, pairs):
    return spark.createDataFrame(sorted(pairs) or [], "source_file string, target_file string")


def ranks_by_force(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = collections.Counter(a for a, _ in pairs)
    rank = dict.fromkeys(nodes, 1 / max(len(nodes), 1))
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15 / max(len(nodes), 1))
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    return rank


def close(found, expected):
    found = {r["file"]: r["rank"] for r in found.collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], expected[k], abs_tol=1e-12) for k in expected)


def test_ranks_after_changes(spark):
    """A chain with branches, a hub that half of all files import; links that come, go and move; files that come and go."""
    r = np.random.default_rng(1)
    pairs = {(f"f{a:03}", f"f{a + b:03}") for a, b in zip(r.integers(0, 120, 200).tolist(), r.integers(1, 5, 200).tolist())}
    pairs |= {(f"f{a:03}", "hub") for a in range(0, 120, 2)}
    stored = maintained.steps(edge_rows(spark, pairs)).checkpoint()
    close(maintained.ranks(stored), ranks_by_force(pairs))
    for step in range(3):
        source = f"f{100 + 5 * step:03}"
        new = {p for p in pairs if p[0] != source} | {(source, "fresh"), (source, "f122")} | ({("new", source)} if step == 1 else set())
        if step == 2:
            new = {p for p in new if "f003" not in p}
        changed = {a for a, _ in pairs ^ new}
        rows = spark.createDataFrame([(x,) for x in sorted(changed)], "file string")
        stored = maintained.updated_steps(stored, edge_rows(spark, pairs), edge_rows(spark, new), rows).checkpoint()
        pairs = new
        close(maintained.ranks(stored), ranks_by_force(pairs))


def test_ranks_of_no_graph_and_of_loops(spark):
    assert maintained.ranks(maintained.steps(edge_rows(spark, set()))).collect() == []
    pairs = {("a", "a"), ("a", "b"), ("b", "a"), ("c", "c")}
    close(maintained.ranks(maintained.steps(edge_rows(spark, pairs))), ranks_by_force(pairs))


def test_top_k_of_blocks(spark):
    """Bounds leave files out, never results; ties by id; queries with repeats, unknown terms and none."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(600):
        words = r.choice([f"w{j}" for j in range(40)], r.integers(0, 25), p=np.arange(40, 0, -1) / 820).tolist()
        rows.append((f"file{i // 4}", f"d{i:03}", words + ["rare"] * (3 * (i % 97 == 0))))
    docs = spark.createDataFrame(rows, "file string, id string, tokens array<string>")
    stored = postings.blocks(docs).checkpoint()
    n, mean = len(rows), sum(len(t) for *_, t in rows) / len(rows)
    for terms in (["rare", "w3"], ["w1", "w1", "w39"], ["rare"], ["unknown"], [], ["w0", "w1", "w2", "w3", "unknown"]):
        score = collections.Counter()
        for term in terms:
            df = sum(term in t for *_, t in rows)
            for _, i, t in rows:
                tf = t.count(term)
                if tf:
                    score[i] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for k in (1, 5, 1000):
            best = sorted((-round(s, 9), i) for i, s in score.items())[:k]
            assert [(-round(x["score"], 9), x["id"]) for x in postings.top_k(stored, terms, k, n, mean).collect()] == best
    hits = postings.weighted(stored, ["rare", "w3"], n)
    assert postings.candidates(hits, 3, mean).count() < hits.select("file").distinct().count() / 2


FILES = {
    "src/a.ts": "import { b } from './b';\nimport x from './lib';\nexport function alphaOne() { return b; }\n",
    "src/b.ts": "export const betaValue = 1;\nexport function betaOne() { return 2; }\n",
    "src/c.ts": "import './a';\nimport './gone';\nexport class Gamma { run() { return 1; } }\n",
    "src/deep/d.ts": "import { b } from '../b';\nimport '../lib/index';\nexport function deltaOne(alpha) { return alpha; }\n",
}


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "project"
    for path, code in FILES.items():
        put(folder, path, code)
    return folder


CLOCK = iter(range(1_900_000_000, 2_000_000_000, 10))


def put(root, path, code):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(code if isinstance(code, bytes) else code.encode())
    os.utime(root / path, (at := next(CLOCK), at))


def status(found):
    return {os.path.basename(r["path"]): r["status"] for r in found.collect()}


def contents(index):
    chunks = sorted((r["id"], r["hash"], r["summary"], r["ord"]) for r in index.store.table("chunks").collect())
    edges = {tuple(r) for r in index.edges().collect()}
    vectors = sorted(r["chunk_id"] for r in index.store.table("embeddings").collect())
    terms = sorted((r["file"], r["term"], r["n"]) for r in index.store.rows("postings").collect())
    at = index.store.last()
    return chunks, edges, vectors, terms, (at.n_files, at.n_chunks, at.n_tokens)


def same_as_fresh(spark, index, root, tmp_path):
    fresh = Index(spark, str(root), store=str(tmp_path / f"fresh{next(CLOCK)}"))
    fresh.build()
    assert contents(index) == contents(fresh)
    close(index.ranks(), ranks_by_force(contents(index)[1]))
    ours, theirs = (i.search("alpha beta value", use_git=False).select("id", F.round("score", 9)).collect() for i in (index, fresh))
    assert ours == theirs


def test_builds_equal_fresh_ones(spark, root, tmp_path, monkeypatch):
    read = []
    by_name = scanning.read_paths
    monkeypatch.setattr(scanning, "read_paths", lambda s, paths: read.append({os.path.basename(p) for p in paths}) or by_name(s, paths))
    index = Index(spark, str(root), store=str(tmp_path / "index"))
    index.build()
    read.clear()
    # a change without another edge: ranks stay as they are stored
    put(root, "src/b.ts", "export const betaValue = 3;\n")
    before = index.store.last()
    assert status(index.build()) == {"a.ts": "unchanged", "b.ts": "changed", "c.ts": "unchanged", "d.ts": "unchanged"}
    assert read == [{"b.ts"}] and index.store.last().ranks == before.ranks
    read.clear()
    # a file that specifiers waited for: `./lib` and `../lib/index` now mean it, and nothing else is read
    put(root, "src/lib/index.ts", "export const lib = 1;\n")
    put(root, "src/lib/[id] {a}.ts", "export const odd = 1;\n")
    index.build()
    assert read == [{"index.ts", "[id] {a}.ts"}]
    same_as_fresh(spark, index, root, tmp_path)
    # one that takes the place of another candidate, one that goes, one that changes its imports
    put(root, "src/lib.ts", "import './c';\nexport const nearer = 1;\n")
    (root / "src/b.ts").unlink()
    put(root, "src/c.ts", "import './deep/d';\nexport class Gamma { walk() { return 1; } }\n")
    assert set(status(index.build()).values()) == {"added", "changed", "deleted", "unchanged"}
    same_as_fresh(spark, index, root, tmp_path)
    monkeypatch.setattr(versions, "MAX_VERSIONS", 2)
    put(root, "src/b.js", "export const back = 1;\n")
    index.build()
    assert index.store._versions("chunks", done=False) == [index.store.last().version]
    monkeypatch.setattr(plans, "NAMED_FILES", 0)  # as if very many had changed
    put(root, "src/b.js", "export const again = 1;\n")
    index.build()
    same_as_fresh(spark, index, root, tmp_path)


def test_search_is_that_of_texts(spark, root, tmp_path):
    index = Index(spark, str(root), store=str(tmp_path / "index"))
    index.build()
    chunks = index.store.table("chunks")
    for query in ("alpha beta", "gamma run gamma", "nothing"):
        ours = index.search(query, use_git=False).select("id", F.round("score", 9).alias("s")).collect()
        vector = index.model()([query])[0]
        texts = hybrid.search(chunks, query, embeddings=index.store.table("embeddings"), query_vector=vector, ranks=graph.pagerank(index.edges()))
        assert ours == texts.select("id", F.round("score", 9).alias("s")).collect()
        own = chunks.select("id", tokenize(hybrid.corpus_text()).alias("tokens"))
        from ctxspark.operators import bm25

        terms = bm25.query_tokens(spark, query)
        expected = own.select("id", bm25.bm25(terms, bm25.statistics(own, terms)).alias("score")).where("score > 0").orderBy(F.desc(F.round("score", 9)), "id").limit(3)
        assert [(r["id"], round(r["score"], 9)) for r in index.keyword_search(query, 3).collect()] == [(r["id"], round(r["score"], 9)) for r in expected.collect()]
    plan = index.search("alpha", use_git=False)._jdf.queryExecution().executedPlan().toString()
    assert "summary" not in plan and "code" not in plan.replace("codegen", "").replace("Codegen", "")


def test_bad_bytes_and_failing_files(spark, root, tmp_path):
    """A Latin-1 byte is no failure. A file that can't be cut keeps its chunks, others go on, and it is tried again."""

    def cut(path, text):
        if "refuse" in text:
            raise ValueError("refused")
        return chunker.chunks_of(path, text)

    index = Index(spark, str(root), store=str(tmp_path / "index"), cut=cut)
    index.build()
    put(root, "src/a.ts", b"// caf\xe9\nexport function alphaTwo() { return 1; }\n")
    put(root, "src/b.ts", "export const refuse = 1;\n")
    put(root, "src/e.ts", "export const refuseToo = 1;\n")
    found = status(index.build())
    assert found == {"a.ts": "changed", "b.ts": "failed", "c.ts": "unchanged", "d.ts": "unchanged", "e.ts": "failed"}
    names = {r["name"] for r in index.store.table("chunks").collect()}
    assert {"alphaTwo", "betaValue", "betaOne"} <= names and "alphaOne" not in names and "refuseToo" not in names
    assert status(index.build())["b.ts"] == "failed"
    put(root, "src/b.ts", "export const accepted = 1;\n")
    (root / "src/e.ts").unlink()
    index.build()
    same_as_fresh(spark, index, root, tmp_path)


def test_failed_write_leaves_the_old_index(spark, root, tmp_path, monkeypatch):
    index = Index(spark, str(root), store=str(tmp_path / "index"))
    index.build()
    before = contents(index)
    for table in ("postings", "edges", "commit"):
        put(root, "src/b.ts", f"export const after{table} = 1;\n")
        write, commit = versions.Versions.write, versions.Versions.commit

        def fail(self, name, *rest):
            if name == table:
                raise OSError("disk full")
            return write(self, name, *rest)

        monkeypatch.setattr(versions.Versions, "write", fail)
        if table == "commit":
            monkeypatch.setattr(versions.Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            index.build()
        assert contents(index) == before
        monkeypatch.setattr(versions.Versions, "write", write)
        monkeypatch.setattr(versions.Versions, "commit", commit)
    index.build()
    same_as_fresh(spark, index, root, tmp_path)


def test_a_change_writes_in_proportion(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(60):
        put(root, f"src/m{i}.ts", "".join(f"export function f{i}x{k}(value) {{ return value + {k}; }}\n" for k in range(40)))
    index = Index(spark, str(root), store=str(tmp_path / "index"))
    index.build()
    put(root, "src/m3.ts", "export function onlyOne(value) { return value; }\n")
    index.build()
    at = index.store.last().version

    def size(table, version):
        base = tmp_path / "index" / table / f"version={version}"
        return sum(f.stat().st_size for f in base.rglob("*.parquet"))

    for table in ("chunks", "embeddings", "postings"):
        assert size(table, at) < size(table, at - 1) / 4


def test_lookups_skip_row_groups(spark, tmp_path, monkeypatch):
    """One key reads one row group of many; a key that isn't there, within the bounds of all, none."""
    monkeypatch.setattr(versions, "OPTIONS", {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.size.row.check.min": "50", "parquet.page.size.row.check.min": "50"})
    store = versions.Versions(spark, str(tmp_path / "store"))
    ids = spark.range(4000).select(F.format_string("f%d.ts#n%05d", F.col("id") % 3, "id").alias("id"), F.format_string("f%d.ts", F.col("id") % 3).alias("file"))
    rows = ids.select("file", "id", *[F.md5("id").alias(c) for c in ("type", "name", "signature", "code", "hash", "summary")], F.lit(1).alias("ord"))
    store.write("chunks", rows.coalesce(1), 1)
    one = F.lit(1).cast("long")
    store.write_files(rows.select(F.col("file").alias("path"), F.lit(0.0).alias("mtime"), one.alias("chunks"), one.alias("tokens"), one.alias("version"), one.alias("edges_version")).distinct(), 1)
    store.commit(versions.Commit(1, 1, 0, 3, 4000, 1), versions.Commit())

    def read(key):
        """Rows that come out, and rows that the scan of the chunks handed over."""
        found = store.stored("chunks").where(F.col("id") == key)
        n = len(found.collect())
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return n, leaves.apply(0).metrics().apply("numOutputRows").value()

    assert [r["name"] for r in store.lookup("chunks", "f2.ts#n00074").collect()] == [rows.where("id = 'f2.ts#n00074'").first()["name"]]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n, handed = read("f2.ts#n00074")
        assert n == 1 and 1 <= handed < 1000
        assert read("f1.ts#n00074") == (0, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
