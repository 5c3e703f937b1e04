"""The query catalogue: name -> DataFrame function, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions import paths
from ctxspark.functions import text as tx
from ctxspark.functions.signature import signature
from ctxspark.operators import bm25 as bm
from ctxspark.operators import budget, chunker, context, graph, hybrid, maintained, postings, recency, report, vector, vector_lists
from ctxspark.plans import adapters as ad
from ctxspark.plans import sql
from ctxspark.plans.adapters import FILE, NOW, QUERY, table
from ctxspark.session import ensure_checkpoint_dir, spread
from ctxspark.sources import files as scanning
from ctxspark.sources import store
from ctxspark.sources.store import Store
from ctxspark.sources.versions import Commit, Versions
from ctxspark.streaming import incremental, listings

_QUERIES: dict = {}
_SQL: dict = {}


def query(statement: str | None = None):
    def keep(function):
        _QUERIES[function.__name__] = function
        if statement is not None:
            _SQL[function.__name__] = statement
        return function

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _list(rows: list) -> str:
    """Rows as SQL VALUES."""
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows)


# --- text, BM25 -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_tf(spark, d):
    own = bm.postings(ad.tokens(spark, d))
    return own.select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, d):
    own = ad.tokens(spark, d).select(F.explode(F.array_distinct("tokens")).alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(avg(len(t)), 6) AS mean FROM (SELECT {sql.tokens('text')} AS t FROM documents)")
def corpus_stats(spark, d):
    own = ad.tokens(spark, d).select(F.size("tokens").alias("n"))
    return own.agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean2")).withColumnRenamed("mean2", "mean")


def _bm25(spark, d, text):
    terms = bm.query_tokens(spark, text)
    ensure_checkpoint_dir(spark)
    # texts are read once: what is left of them is the terms' frequencies
    own = ad.tokens(spark, d).select("id", F.size("tokens").alias("dl"), *bm.frequencies(terms)).checkpoint()
    return own.select("id", bm.bm25_of_counts(terms, bm.statistics_of_counts(own, terms)).alias("score")).where("score > 0")


@query(f"WITH {sql.bm25('documents', 'text', 'doc_id', 'onTion heea')} SELECT key AS doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, key LIMIT 10")
def bm25_topk(spark, d):
    found = _bm25(spark, d, "onTion heea").orderBy(F.desc("score"), "id").limit(10)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {sql.bm25('documents', 'text', 'doc_id')} SELECT key AS doc_id, round(score, 6) AS score FROM bm WHERE score > 0")
def bm25_dup_terms(spark, d):
    return _bm25(spark, d, QUERY).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {sql.bm25('documents', 'text', 'doc_id')} SELECT key AS doc_id, round(score / greatest((SELECT max(score) FROM bm), 0.001), 6) AS score FROM bm WHERE score > 0")
def bm25_normalized(spark, d):
    found = _bm25(spark, d, QUERY)
    top = F.broadcast(found.agg(F.greatest(F.max("score"), F.lit(hybrid.FLOOR)).alias("top")))  # one row
    return found.join(top).select(F.col("id").alias("doc_id"), F.round(F.col("score") / F.col("top"), 6).alias("score"))


@query(_SQL["bm25_dup_terms"])
def bm25_postings(spark, d):
    terms = bm.query_tokens(spark, QUERY)
    ensure_checkpoint_dir(spark)
    # texts are read once: what is left of them is their length and the query's terms
    own = ad.tokens(spark, d).select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda x: x.isin(*terms)).alias("tokens")).checkpoint()
    row = own.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    found = bm.bm25_postings(bm.postings(own, length=F.col("dl")), terms, row["n"], row["mean"])
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_SQL["bm25_topk"])
def postings_topk(spark, d):
    """The same from an inverted index on disk: written once, then only the terms' buckets are read, and only blocks that may hold one of the ten are opened."""
    own = Versions(spark, _scratch(spark))
    read = spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    docs = read.select(ad.file_of().alias("file"), F.col("doc_id").alias("id"), tx.tokenize("text").alias("tokens"))
    own.write("postings", postings.blocks(docs), 1)
    # texts are cut once: a file's tokens are the frequencies in its blocks
    none = F.lit(0).cast("long")
    summed = own.stored("postings").select("file", none.alias("chunks"), F.aggregate("found.tf", none, lambda s, x: s + x).alias("tokens"))
    sizes = docs.select("file", F.lit(1).cast("long").alias("chunks"), none.alias("tokens")).union(summed)
    sizes = sizes.groupBy(F.col("file").alias("path")).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
    one = F.lit(1).cast("long")
    listed = own.write_files(sizes.select("path", F.lit(0.0).alias("mtime"), "chunks", "tokens", one.alias("version"), one.alias("edges_version")), 1)
    row = listed.agg(F.count("*").alias("files"), F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens")).first()
    own.commit(Commit(1, 1, 0, row["files"], row["n"], row["tokens"]), Commit())
    terms = bm.query_tokens(spark, "onTion heea")
    stored = own.valid("postings", own.stored("postings").where(F.col("term").isin(terms)))
    found = postings.top_k(stored.withColumn("found", F.transform("found", lambda x: x.withField("id", x["id"].cast("long")))), terms, 10, row["n"], row["tokens"] / row["n"])
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# --- vectors ----------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, {sql.cosine('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY round(score, 12) DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    found = vector.top_k(table(spark, d, "embeddings"), ad.query_vector(spark, d), 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, vec_id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {sql.cosine('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql.cosine('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def cosine_search_all(spark, d):
    vectors = table(spark, d, "embeddings")
    found = vector.search_all(vectors.where("vec_id % 100 = 0"), vectors, 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(_SQL["cosine_search_all"])
def cosine_search_lists(spark, d):
    """The same by inverted lists: those that can't hold one of the ten best aren't read."""
    vectors = table(spark, d, "embeddings")
    found = vector_lists.search(vector_lists.build(vectors), vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


GUARDS = [("same", [1.0, 2.0], [2.0, 4.0]), ("opposite", [1.0, 0.0], [-1.0, 0.0]), ("lengths", [1.0], [1.0, 2.0]), ("empty", [], []), ("zero", [0.0, 0.0], [1.0, 1.0])]


@query("SELECT * FROM (VALUES ('same', 1.0::DOUBLE), ('opposite', -1.0), ('lengths', 0.0), ('empty', 0.0), ('zero', 0.0)) t(name, score)")
def cosine_guards(spark, d):
    rows = _values(spark, GUARDS, "name string, a array<double>, b array<double>")
    return rows.select("name", F.round(vector.cosine(F.col("a"), F.col("b")), 9).alias("score"))


@query(f"WITH {sql.CHUNKS} SELECT id FROM chunks WHERE ord NOT IN (SELECT vec_id FROM embeddings)")
def chunks_without_embeddings(spark, d):
    return store.without_embeddings(ad.chunks(spark, d).select("id"), ad.vectors(spark, d)).select("id")


# --- graph ------------------------------------------------------------------------------------------------


@query(f"WITH {sql.EDGES} SELECT source_file, target_file FROM edges")
def dep_edges(spark, d):
    return ad.edges(spark, d)


@query(f"WITH {sql.EDGES} SELECT source_file AS file, count(*) AS imports FROM edges GROUP BY source_file")
def out_degree(spark, d):
    return graph.out_degree(ad.edges(spark, d))


@query(f"WITH {sql.EDGES} SELECT source_file AS file FROM edges UNION SELECT target_file FROM edges")
def graph_nodes(spark, d):
    return graph.nodes_of(ad.edges(spark, d))


@query(f"WITH {sql.EDGES}, {sql.ranks()} SELECT file, round(rank, 9) AS rank FROM ranks")
def pagerank(spark, d):
    return graph.pagerank(ad.edges(spark, d)).select("file", F.round("rank", 9).alias("rank"))


@query(_SQL["pagerank"])
def pagerank_by_joins(spark, d):
    return graph.pagerank_by_joins(ad.edges(spark, d)).select("file", F.round("rank", 9).alias("rank"))


@query(_SQL["pagerank"])
def pagerank_maintained(spark, d):
    """Ranks of a graph without the links of one source, brought up to date when these come."""
    new = ad.edges(spark, d).checkpoint()
    late = F.col("source_file").startswith("src/src1/")
    old = new.where(~late)
    stored = maintained.steps(old).checkpoint()
    changed = new.where(late).select(F.col("source_file").alias("file")).distinct()
    found = maintained.ranks(maintained.updated_steps(stored, old, new, changed))
    return found.select("file", F.round("rank", 9).alias("rank"))


@query(f"WITH {sql.EDGES}, {sql.ranks('SELECT DISTINCT file FROM files')} SELECT file, round(rank, 9) AS rank FROM ranks")
def pagerank_all_nodes(spark, d):
    return graph.pagerank(ad.edges(spark, d), ad.files(spark, d)).select("file", F.round("rank", 9).alias("rank"))


@query(f"WITH {sql.EDGES}, {sql.ranks()} SELECT file, round(rank, 9) AS rank FROM ranks ORDER BY round(rank, 12) DESC, file LIMIT 10")
def pagerank_top(spark, d):
    return graph.pagerank(ad.edges(spark, d)).orderBy(F.desc(F.round("rank", 12)), "file").limit(10).select("file", F.round("rank", 9).alias("rank"))


GOLDEN_EDGES = [("A", "B"), ("A", "C"), ("B", "C")]


@query("SELECT * FROM (VALUES ('A', 0.05::DOUBLE), ('B', 0.07125), ('C', 0.1318125)) t(file, rank)")
def pagerank_golden(spark, d):
    return graph.pagerank(_values(spark, GOLDEN_EDGES, "source_file string, target_file string")).select("file", F.round("rank", 9).alias("rank"))


@query(f"WITH {sql.EDGES}, {sql.NEIGHBOURS} SELECT file FROM near")
def graph_neighbors(spark, d):
    return graph.neighbours(ad.edges(spark, d), FILE)


@query(f"WITH {sql.CHUNKS}, {sql.EDGES}, {sql.NEIGHBOURS} SELECT id, file FROM chunks WHERE file IN (SELECT file FROM near)")
def neighbor_chunks(spark, d):
    return context.neighbour_chunks(ad.chunks(spark, d), ad.edges(spark, d), FILE).select("id", "file")


# --- recency ----------------------------------------------------------------------------------------------


@query(f"WITH {sql.LATEST} SELECT file AS path, round(recency, 9) AS recency FROM recent")
def recency_scores(spark, d):
    return recency.recency(ad.commits(spark, d), NOW).select("path", F.round("recency", 9).alias("recency"))


@query(f"WITH {sql.LATEST} SELECT path, ts FROM latest")
def recency_latest_per_file(spark, d):
    return recency.latest_per_file(ad.commits(spark, d)).select("path", "ts")


SUFFIXES = [("src1/en.ts", 2, 0.5), ("repo/src2/fr.ts", 1, 0.25), ("en.ts", 3, 0.125), ("c1/en.ts", 0, 0.75)]


@query(f"""WITH {sql.FILES}, s(path, o, r) AS (VALUES {_list(SUFFIXES)})
SELECT file, min_by(r, o)::DOUBLE AS recency FROM (SELECT DISTINCT file FROM files) f JOIN s ON suffix(f.file, s.path) OR suffix(s.path, {sql.short('f.file')}) GROUP BY file""")
def suffix_join_recency(spark, d):
    recent = _values(spark, SUFFIXES, "path string, commit_ord int, recency double")
    return recency.match_files(ad.files(spark, d), recent)


HOT_FILE = "'/src/' || source || '/' || lang || '/d' || (doc_id % 7) || CASE WHEN doc_id % 3 = 0 THEN '/index.ts' ELSE '/f' || doc_id || '.ts' END"


@query(f"""WITH f AS (SELECT DISTINCT {HOT_FILE} AS file FROM documents),
s AS (SELECT DISTINCT file[1 + doc_id % 13:] AS path FROM (SELECT doc_id, {HOT_FILE} AS file FROM documents WHERE doc_id % 5 = 0))
SELECT file, count(*) AS n, min(path) AS first, max(path) AS last FROM f JOIN s ON suffix(file, path) GROUP BY file""")
def suffix_join_hot(spark, d):
    """Files that end with given paths; a third of them are called index.ts."""
    docs = table(spark, d, "documents")
    file = F.expr(HOT_FILE)
    files = docs.select(file.alias("file")).distinct()
    ends = docs.where("doc_id % 5 = 0").select(F.expr(f"substring({HOT_FILE}, int(1 + doc_id % 13))").alias("path")).distinct()
    found = paths.ending_pairs(files, "file", ends, "path")
    return found.groupBy("file").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


LOG = ["1700000300 abc123", "", "src/a.ts", "src/b.ts", "1700000200 def456", "src/a.ts", "  ", "1700000100 0a0b0c", "src/c.ts"]


@query("""SELECT * FROM (VALUES (1, 1700000300, 'src/a.ts'), (1, 1700000300, 'src/b.ts'), (2, 1700000200, 'src/a.ts'), (3, 1700000100, 'src/c.ts')) t(commit_ord, committed, path)""")
def log_carry_forward(spark, d):
    parsed = recency.parse_log(_values(spark, list(enumerate(LOG)), "line_no int, line string"))
    return parsed.select(F.col("commit_ord").cast("int").alias("commit_ord"), F.unix_seconds("ts").cast("int").alias("committed"), "path")


# --- hybrid -----------------------------------------------------------------------------------------------


NAMES = "almond blush green midnight green"


@query(f"SELECT p_partkey, {sql.matches('p_name', NAMES)}::INTEGER AS matches FROM part")
def name_boost(spark, d):
    terms = bm.query_tokens(spark, NAMES)
    return table(spark, d, "part").select("p_partkey", tx.name_matches("p_name", terms).alias("matches"))


def _signals(spark, d, embedding=True):
    edges = ad.edges(spark, d).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else ad.edges(spark, d)
    recent = recency.recency(ad.commits(spark, d), NOW).select(F.col("path").alias("file"), "recency")
    return {
        "embeddings": ad.vectors(spark, d) if embedding else None,
        "query_vector": ad.query_vector(spark, d) if embedding else None,
        "ranks": graph.pagerank(edges),
        "recent": recent,
    }


def _found(spark, d, k=10, **more):
    chunks = ad.chunks(spark, d)
    return hybrid.search(chunks, QUERY, k, **(_signals(spark, d) | more))


TOP = "SELECT * FROM hy WHERE score > 0 ORDER BY round(score, 12) DESC, id LIMIT"


@query(f"WITH {sql.hybrid()} SELECT id, file, round(score, 6) AS score FROM ({TOP} 10)")
def hybrid_search(spark, d):
    return _found(spark, d).select("id", "file", F.round("score", 6).alias("score"))


@query(f"WITH {sql.hybrid()} SELECT id, round(score, 6) AS score FROM hy WHERE score > 0")
def hybrid_scores(spark, d):
    return hybrid.scored(ad.chunks(spark, d), QUERY, **_signals(spark, d)).where("score > 0").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {sql.hybrid(embedding=False)} SELECT id, file, round(score, 6) AS score FROM ({TOP} 10)")
def hybrid_no_embedding(spark, d):
    found = hybrid.search(ad.chunks(spark, d), QUERY, 10, **_signals(spark, d, embedding=False))
    return found.select("id", "file", F.round("score", 6).alias("score"))


@query(f"WITH {sql.hybrid(weights=(0.6, 0.2, 0.05, 0.05, 0.1))} SELECT id, file, round(score, 6) AS score FROM ({TOP} 10)")
def hybrid_custom_weights(spark, d):
    weights = hybrid.Weights(bm25=0.6, embedding=0.2, page_rank=0.05, name_boost=0.05, recency=0.1)
    return _found(spark, d, weights=weights).select("id", "file", F.round("score", 6).alias("score"))


# --- context and packing ----------------------------------------------------------------------------------

FIFTEEN = f"found AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS position FROM ({TOP} 15))"
NEAR = """nc AS (SELECT c.*, row_number() OVER (ORDER BY file, ord, id) AS position FROM chunks c WHERE file IN (SELECT file FROM near))"""
ENTRIES = f"""{sql.hybrid()}, {sql.NEIGHBOURS}, {FIFTEEN}, {NEAR},
entries AS (
  SELECT 'graph' AS section, position, id, file, signature FROM nc WHERE position <= 15
  UNION ALL SELECT 'search', position, id, file, signature FROM found WHERE id NOT IN (SELECT id FROM nc WHERE position <= 15))"""


def _parts(spark, d, k=15):
    return ad.chunks(spark, d), ad.edges(spark, d), _found(spark, d, k)


@query(f"WITH {ENTRIES} SELECT section, position, id, file FROM entries")
def context_entries(spark, d):
    found = context.entries(*_parts(spark, d), FILE)
    return found.select("section", F.col("position").cast("long").alias("position"), "id", "file")


@query(f"""WITH {ENTRIES}, costed AS (SELECT *, ceil(len(signature) / 4.0)::BIGINT + 10 AS cost FROM entries),
  run AS (SELECT *, sum(cost) OVER (ORDER BY section, position) AS used FROM costed) SELECT id, cost, used::BIGINT AS used FROM run WHERE used <= 500""")
def context_pack_cli(spark, d):
    return context.pack_cli(context.entries(*_parts(spark, d), FILE), 500).select("id", "cost", F.col("used").cast("long").alias("used"))


def _line(indent: str = "", end: str = "''") -> str:
    return f"'{indent}' || {sql.short('file')} || ': ' || signature || {end}"


@query(f"""WITH {sql.hybrid()}, {FIFTEEN}, l AS (SELECT id, position, {_line()} AS line FROM found WHERE position <= 10),
  c AS (SELECT *, {sql.estimate('line')} AS cost FROM l), r AS (SELECT *, sum(cost) OVER (ORDER BY position) AS used FROM c)
  SELECT id, line, cost, used::BIGINT AS used FROM r WHERE used <= 300""")
def search_pack(spark, d):
    return context.pack_search(_found(spark, d), 300).select("id", "line", "cost", F.col("used").cast("long").alias("used"))


@query(f"""WITH {sql.hybrid()}, {sql.NEIGHBOURS}, {FIFTEEN}, {NEAR},
  a AS (SELECT id, position, {sql.estimate(_line('  ', 'chr(10)'))} AS cost FROM nc WHERE position <= 10),
  a1 AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) AS used FROM a) WHERE used <= 0.4 * 600),
  b AS (SELECT id, position, {sql.estimate(_line('  ', 'chr(10)'))} AS cost FROM found WHERE id NOT IN (SELECT id FROM nc)),
  b1 AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) + (SELECT coalesce(sum(cost), 0) FROM a1) AS used FROM b) WHERE used <= 600)
  SELECT 'architecture' AS section, id, cost, used::BIGINT AS used FROM a1 UNION ALL SELECT 'related', id, cost, used::BIGINT FROM b1""")
def context_pack_mcp(spark, d):
    return context.pack_tool(*_parts(spark, d), FILE, 600).select("section", "id", "cost", "used")


@query(f"""WITH {sql.hybrid()}, {sql.NEIGHBOURS}, {FIFTEEN},
  mine AS (SELECT *, row_number() OVER (ORDER BY file, ord, id) AS position FROM chunks WHERE file = '{FILE}'),
  nx AS (SELECT *, row_number() OVER (ORDER BY file, ord, id) AS position FROM chunks WHERE file IN (SELECT file FROM near) AND file <> '{FILE}'),
  a AS (SELECT id, position, {sql.estimate("'  ' || name || ': ' || signature || chr(10)")} AS cost FROM mine WHERE position <= 8),
  a1 AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) AS used FROM a) WHERE used <= 0.3 * 2000),
  b AS (SELECT id, position, {sql.estimate(_line('  ', 'chr(10)'))} AS cost FROM nx WHERE position <= 5),
  b1 AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) + (SELECT coalesce(sum(cost), 0) FROM a1) AS used FROM b) WHERE used <= 0.5 * 2000),
  c AS (SELECT id, position, {sql.estimate(_line('  ', 'chr(10)'))} AS cost FROM found WHERE position <= 10 AND id NOT IN (SELECT id FROM mine) AND id NOT IN (SELECT id FROM nx)),
  c1 AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY position) + (SELECT coalesce(sum(cost), 0) FROM (SELECT cost FROM a1 UNION ALL SELECT cost FROM b1)) AS used FROM c) WHERE used <= 2000)
  SELECT 'current' AS section, id, cost, used::BIGINT AS used FROM a1 UNION ALL SELECT 'dependencies', id, cost, used::BIGINT FROM b1 UNION ALL SELECT 'related', id, cost, used::BIGINT FROM c1""")
def auto_pack(spark, d):
    return context.pack_auto(*_parts(spark, d, 10), FILE).select("section", "id", "cost", "used")


ITEMS = [("1", "aaaa " * 5, 0.7, "search", "x"), ("2", "aaaa " * 6, 0.5, "graph", "x"), ("3", "aa bb", 0.6, "search", "x"), ("4", "", 0.1, "search", "y")]


@query("SELECT * FROM (VALUES ('x', ['2', '3'], 8::BIGINT, 100::BIGINT, 1::BIGINT), ('y', ['4'], 0, 0, 0)) t(g, kept, total_tokens, budget_used, dropped)")
def pack_entries_greedy(spark, d):
    return budget.pack_greedy(_values(spark, ITEMS, "id string, text string, score double, source string, g string"), 8, ["g"])


@query(f"SELECT doc_id, {sql.estimate('text')} AS tokens FROM documents")
def estimate_tokens(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.estimate_tokens("text").alias("tokens"))


MODELS = ["gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "o1-mini", "o3-mini", "Claude-3.5-Sonnet", "claude-3-5-sonnet", "phi-3-medium", None]


@query("""SELECT * FROM (VALUES ('gpt-4o', 6000), ('gpt-4o-mini', 6000), ('gpt-4-turbo', 6000), ('o1-mini', 8000), ('o3-mini', 10000), ('Claude-3.5-Sonnet', 10000),
  ('claude-3-5-sonnet', 4000), ('phi-3-medium', 2000), (NULL, 4000)) t(model, budget)""")
def token_budget_by_model(spark, d):
    return _values(spark, [(m,) for m in MODELS], "model string").select("model", budget.model_budget("model").alias("budget"))


@query(f"""WITH l AS (SELECT doc_id, text, {sql.estimate('text')} AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  c AS (SELECT *, sum({sql.estimate('line')}) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l),
  k AS (SELECT doc_id, any_value(text) AS text, any_value(whole) AS whole, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (used <= 95), '') AS kept, coalesce(max(used) FILTER (used <= 95), 0) AS n FROM c GROUP BY doc_id)
  SELECT doc_id, CASE WHEN whole <= 100 THEN whole ELSE n + 5 END::BIGINT AS tokens,
         md5(CASE WHEN whole <= 100 THEN text ELSE kept || chr(10) || '... (truncated, ' || (whole - n)::BIGINT || ' tokens omitted)' END) AS digest FROM k""")
def pack_text(spark, d):
    packed = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", budget.pack_text("text", 100).alias("p"))
    return packed.select("doc_id", F.col("p.tokens").alias("tokens"), F.md5("p.text").alias("digest"))


# --- diff -------------------------------------------------------------------------------------------------

CHANGED = [("src1/en.ts",), ("app/src/src2/fr.ts",)]
TOUCHED = f"""ch(path) AS (VALUES {_list(CHANGED)}),
touched AS (SELECT DISTINCT f.file FROM files f JOIN ch ON f.file = path OR suffix(f.file, path) OR suffix(path, f.file)),
dn AS (SELECT target_file AS file FROM edges WHERE source_file IN (SELECT file FROM touched) UNION SELECT source_file FROM edges WHERE target_file IN (SELECT file FROM touched)),
deps AS (SELECT * FROM chunks WHERE file IN (SELECT file FROM dn) AND file NOT IN (SELECT file FROM touched) ORDER BY file, ord, id LIMIT 20)"""


def _changed(spark):
    return _values(spark, CHANGED, "path string")


@query(f"WITH {sql.CHUNKS}, {sql.EDGES}, {TOUCHED} SELECT id FROM chunks WHERE file IN (SELECT file FROM touched)")
def diff_changed_chunks(spark, d):
    return context.changed_chunks(ad.chunks(spark, d), _changed(spark)).select("id")


@query(f"WITH {sql.CHUNKS}, {sql.EDGES}, {TOUCHED} SELECT id, file FROM deps")
def diff_dependencies(spark, d):
    return context.diff_dependencies(ad.chunks(spark, d), ad.edges(spark, d), _changed(spark)).select("id", "file")


@query(f"""WITH {sql.hybrid()}, {TOUCHED} SELECT id, round(score, 6) AS score FROM ({TOP} 10)
  WHERE id NOT IN (SELECT id FROM chunks WHERE file IN (SELECT file FROM touched)) AND id NOT IN (SELECT id FROM deps)""")
def diff_related(spark, d):
    found = context.diff_related(ad.chunks(spark, d), ad.edges(spark, d), _changed(spark), _found(spark, d))
    return found.select("id", F.round("score", 6).alias("score"))


# --- reports ----------------------------------------------------------------------------------------------


@query(f"""WITH {sql.CHUNKS}, {sql.EDGES} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT file) FROM chunks) AS files,
  (SELECT count(*) FROM chunks WHERE ord IN (SELECT vec_id FROM embeddings)) AS embeddings, (SELECT count(*) FROM edges) AS edges""")
def stats_counts(spark, d):
    return report.stats(ad.chunks(spark, d), ad.vectors(spark, d), ad.edges(spark, d))


@query(f"WITH {sql.CHUNKS} SELECT type, count(*) AS n FROM chunks GROUP BY type")
def stats_by_type(spark, d):
    return report.by_type(ad.chunks(spark, d))


@query("SELECT 'src/' || source || '/' || lang || '.ts' AS file, count(*) AS n, count(DISTINCT md5(text)) AS kinds FROM documents GROUP BY 1")
def chunks_per_file(spark, d):
    return ad.chunks(spark, d).groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("kinds"))


PATHS = [
    "src/api/userController.ts", "src/api/UserService.ts", "src/dal/orders.ts", "src/models/order.js", "src/routes/index.ts", "src/mw/validatorChain.ts",
    "src/utils/strings.ts", "src/types/api.ts", "src/config/db.ts", "test/spec/a.ts", "src/main.ts", "lib/core.ts", "a.ts",
]


def _path_rows(spark):
    return _values(spark, [(p, p, i, str(i)) for i, p in enumerate(PATHS)], "file string, name string, ord int, id string")


def _layers_sql(rule: str) -> str:
    return f"""WITH p(path) AS (VALUES {_list([(p,) for p in PATHS])}), s AS (SELECT DISTINCT {sql.short('path')} AS file FROM p),
      l AS (SELECT file, {rule} AS layer FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY file) AS rn FROM l)
      SELECT layer, count(*) AS files, string_agg(file, ', ' ORDER BY file) FILTER (rn <= 8) AS listed FROM r GROUP BY layer"""


@query(_layers_sql(sql.layer("file")))
def explain_layers_cli(spark, d):
    return report.layers(_path_rows(spark))


@query(_layers_sql(sql.TOOL_LAYER))
def explain_layers_mcp(spark, d):
    return report.tool_layers(_path_rows(spark))


@query(f"WITH {sql.EDGES} SELECT source_file AS file, count(*) AS imports FROM edges GROUP BY 1 ORDER BY imports DESC, file LIMIT 5")
def explain_top_importers(spark, d):
    return report.top_importers(ad.edges(spark, d))


@query(f"""WITH {sql.CHUNKS}, {sql.EDGES}, {sql.ranks()} SELECT r.file, round(rank, 9) AS rank, (SELECT count(*) FROM chunks c WHERE c.file = r.file) AS chunks
  FROM ranks r ORDER BY round(rank, 12) DESC, r.file LIMIT 10""")
def explain_important_files(spark, d):
    ranks = graph.pagerank(ad.edges(spark, d)).withColumn("rank", F.round("rank", 12))
    return report.important_files(ranks, ad.chunks(spark, d)).withColumn("rank", F.round("rank", 9))


def _names_sql(n: int, rest: str = "") -> str:
    return f"""WITH {sql.CHUNKS}, s AS (SELECT {sql.short('file')} AS file, name, row_number() OVER (PARTITION BY {sql.short('file')} ORDER BY ord, id) AS rn FROM chunks)
      SELECT file, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= {n}) AS names, greatest(count(*) - {n}, 0)::BIGINT AS more, count(*) AS total FROM s GROUP BY file {rest}"""


@query(_names_sql(5))
def explain_names_per_file(spark, d):
    return report.names_per_file(ad.chunks(spark, d))


@query(_names_sql(8, "ORDER BY total DESC, file LIMIT 30"))
def instructions_top_files(spark, d):
    return report.instructions(ad.chunks(spark, d))


# --- store and increments ---------------------------------------------------------------------------------

OLD = "SELECT d.doc_id::VARCHAR AS path, (n_chars + toxic)::DOUBLE AS mtime FROM documents d JOIN labels l USING (doc_id)"
NEW = "SELECT doc_id::VARCHAR AS path, n_chars::DOUBLE AS mtime FROM documents WHERE lang <> 'de'"


@query(f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added'
  WHEN o.mtime = n.mtime THEN 'unchanged' ELSE 'changed' END AS status FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.path = n.path""")
def incremental_status(spark, d):
    return incremental.status(*ad.snapshots(spark, d))


@query(f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) WHERE path NOT IN (SELECT path FROM ({NEW}))")
def upsert_last_wins(spark, d):
    old, new = ad.snapshots(spark, d)
    twice = old.withColumn("at", F.lit(0)).union(new.withColumn("mtime", F.col("mtime") - 1).withColumn("at", F.lit(1))).union(new.withColumn("at", F.lit(2)))
    return store.upsert(old, store.last_per_key(twice, "path", "at").drop("at"), "path").select("path", "mtime")


@query(f"""WITH {sql.CHUNKS}, gone AS (SELECT ord FROM chunks WHERE file = '{FILE}')
  SELECT 'chunks' AS kind, (SELECT count(*) FROM chunks) - (SELECT count(*) FROM gone) AS n
  UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings e JOIN chunks c ON e.vec_id = c.ord WHERE c.file <> '{FILE}')
  UNION ALL SELECT 'files', (SELECT count(DISTINCT file) - 1 FROM chunks)""")
def remove_file_cascade(spark, d):
    files = ad.files(spark, d).withColumnRenamed("file", "path")
    left = store.remove_file(ad.chunks(spark, d), ad.vectors(spark, d), files, FILE)
    named = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in zip(("chunks", "embeddings", "files"), left)]
    return named[0].union(named[1]).union(named[2])


@query(f"WITH {sql.CHUNKS} SELECT id FROM chunks WHERE NOT suffix(file, 'src1/en.ts')")
def remove_chunks_by_suffix(spark, d):
    return store.remove_chunks_for_file(ad.chunks(spark, d), ad.vectors(spark, d), "src1/en.ts")[0].select("id")


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query(f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) WHERE path NOT IN (SELECT path FROM ({NEW}))")
def store_round_trip(spark, d):
    """Write, merge, read again."""
    own = Store(spark, _scratch(spark))
    old, new = ad.snapshots(spark, d)
    own.upsert("files", old.withColumn("hash", F.lit("")))
    own.upsert("files", new.withColumn("hash", F.lit("")))
    return own.table("files").select("path", "mtime")


@query("SELECT user_id::VARCHAR AS path, max(epoch_us(ts))::DOUBLE AS mtime FROM events GROUP BY 1")
def stream_incremental(spark, d):
    """A stream of events, one row per user kept: the newest."""
    own, place = Store(spark, _scratch(spark)), _scratch(spark)
    events = table(spark, d, "events")
    changes = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(
        F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("mtime"), F.lit("").alias("hash")
    )
    incremental.follow(changes, own, "files", place, "mtime").awaitTermination()
    return own.table("files").select("path", "mtime")


def _sources(spark, d, keep: str, shift: int):
    """(path, code): a source per file of the documents that `keep` takes; each imports the file of document (7 d + shift) mod N."""
    docs = table(spark, d, "documents")
    n = docs.count()
    to = docs.select(F.col("doc_id").alias("to"), F.concat(F.lit("../"), "source", F.lit("/"), "lang").alias("target"))
    linked = docs.where(keep).withColumn("to", F.pmod(F.col("doc_id") * 7 + shift, F.lit(n))).join(to, "to")
    line = F.concat(F.lit("import { f"), "doc_id", F.lit(" } from '"), "target", F.lit("';"))
    return linked.groupBy(F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit(".ts")).alias("path")).agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("code")
    )


def _edges_sql(keep: str, shift: int) -> str:
    return f"""SELECT DISTINCT '/src/' || a.source || '/' || a.lang || '.ts' AS source_file, '/src/' || b.source || '/' || b.lang || '.ts' AS target_file
    FROM documents a JOIN documents b ON (a.doc_id * 7 + {shift}) % (SELECT count(*) FROM documents) = b.doc_id
    WHERE a.{keep} AND EXISTS (SELECT 1 FROM documents c WHERE c.{keep} AND c.source = b.source AND c.lang = b.lang)"""


@query(_edges_sql("lang <> 'de'", 3))
def source_imports(spark, d):
    """Import declarations of sources, resolved to files."""
    return graph.dependency_edges(_sources(spark, d, "lang <> 'de'", 3))


@query(_edges_sql("lang <> 'es'", 3))
def edges_maintained(spark, d):
    """Edges after a change: German files come, Spanish ones go, and those of one source import others; only what these touch is resolved again."""
    old, new = _sources(spark, d, "lang <> 'de'", 5), _sources(spark, d, "lang <> 'es'", 3)
    own = Versions(spark, _scratch(spark))
    was, now = old.withColumn("hash", F.md5("code")).checkpoint(), new.withColumn("hash", F.md5("code")).checkpoint()
    own.write("specifiers", maintained.specifiers(was), 1)
    own.write("edges", maintained.resolve(own.stored("specifiers"), was), 1)
    both = was.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full_outer").checkpoint()
    fresh = now.join(both.where("new is not null and not old <=> new").select("path"), "path", "left_semi")
    own.write("specifiers", maintained.specifiers(fresh), 2)
    version = F.when(F.expr("old <=> new"), 1).otherwise(2).cast("long")
    listed = both.where("new is not null").select(F.col("path").alias("file"), version.alias("version")).checkpoint()
    specifiers = own.stored("specifiers").join(listed, ["file", "version"])
    moved = both.where("old is null or new is null").select("path")
    again = maintained.touched(specifiers, moved).union(fresh.select(F.col("path").alias("file"))).distinct().checkpoint()
    paths = listed.select(F.col("file").alias("path"))
    resolved = own.write("edges", maintained.resolve(specifiers.join(again, "file", "left_semi"), paths), 2)
    kept = own.stored("edges").where("version = 1").join(listed, "file", "left_semi").join(again, "file", "left_anti").select("file", "target_file")
    return kept.union(resolved).select(F.col("file").alias("source_file"), "target_file")


@query(f"""WITH o AS ({OLD}), n AS ({NEW})
SELECT path, 'added' AS status, 1 AS listing FROM o
UNION ALL SELECT path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END, 2 FROM n LEFT JOIN o USING (path) WHERE o.path IS NULL OR o.mtime <> n.mtime
UNION ALL SELECT path, 'deleted', 2 FROM o WHERE path NOT IN (SELECT path FROM n)""")
def stream_deletions(spark, d):
    """Two listings of paths as a stream: what the second one lacks is deleted by a timer."""
    place = _scratch(spark)
    for hour, listing in enumerate(ad.snapshots(spark, d), 1):
        rows = listing.withColumn("listed", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp"))
        rows.repartition(1).write.mode("append").parquet(f"{place}/in")
    found = listings.follow(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint")
    # a deletion is just after the last listing that had the path
    return found.select("path", "status", F.when(F.col("status") == "deleted", 2).otherwise(F.hour("listed")).alias("listing"))


# --- names, paths, signatures, imports, declarations -----------------------------------------------------


@query(f"WITH p(path) AS (VALUES {_list([(p,) for p in PATHS])}) SELECT path, {sql.short('path')} AS short FROM p")
def short_path(spark, d):
    return _values(spark, [(p,) for p in PATHS], "path string").select("path", tx.short_path("path").alias("short"))


@query(f"WITH {sql.CHUNKS} SELECT id, {sql.human('name')} AS human FROM chunks")
def human_name(spark, d):
    return ad.chunks(spark, d).select("id", tx.human_name("name").alias("human"))


@query(f"WITH {sql.CHUNKS} SELECT id, string_split(file, '/')[-1] || ' ' || {sql.human('name')} || ' ' || signature AS text FROM chunks")
def searchable_text(spark, d):
    return ad.chunks(spark, d).select("id", tx.searchable_text("file", "name", "signature", "code").alias("text"))


SEARCHABLE = [("src/a/http.ts", "parseHTTPResponse", "function parseHTTPResponse(x)", "/**\n * Parses it.\n * @param x y\n *\n * Twice. */\nfunction parseHTTPResponse(x) {}")]


@query("SELECT 'http.ts parse http response function parseHTTPResponse(x) Parses it. Twice.' AS text")
def searchable_text_comment(spark, d):
    return _values(spark, SEARCHABLE, "f string, n string, s string, c string").select(tx.searchable_text("f", "n", "s", "c").alias("text"))


CASES = {
    "parseHTTPResponse": ["parse", "http", "response"], "getS3Bucket": ["get", "s3bucket"], "XMLHttpRequestFactory": ["xml", "http", "request", "factory"],
    "user_id42 Größe": ["user", "id42", "gr"], "a.bC": [],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::VARCHAR[])" for k, v in CASES.items()) + ") t(text, tokens)")
def tokenize_golden(spark, d):
    return _values(spark, [(k,) for k in CASES], "text string").select("text", tx.tokenize("text").alias("tokens"))


def _signatures(spark, rows):
    return _values(spark, rows, "kind string, code string, name string, expected string").select("kind", "code", signature("kind", "code", "name").alias("signature"))


def _signatures_sql(rows) -> str:
    return "SELECT kind, code, signature FROM (VALUES " + _list(rows) + ") t(kind, code, name, signature)"


LONG = "  const value = '" + "x" * 200 + "'"
FUNCTIONS = [
    ("function", "export function f({a,b}, c = {}) {\n  return a\n}", "f", "export function f("),
    ("arrow-function", "const f = () => {\n}", "f", "const f = () =>"),
    ("arrow-function", "const f = (a) =>\n  a + 1", "f", "const f = (a) =>"),
    ("function", "/** Adds. */\n// really\nfunction add(\n  a: number,\n  b: number\n): number {\n}", "add", "function add( a: number, b: number ): number"),
    ("method", "*gen() {\n  yield 1\n}", "A.gen", "yield 1 }"),
    ("function", "// nothing", "g", "g"),
]
CLASSES = [
    ("class", "export default class A {\n}", "A", "class A"),
    ("class", "export class B extends A {\n  constructor(x) {\n    if (x) {\n    }\n  }\n  async load(y) {\n  }\n  public foo(x) {\n  }\n}", "B", "export class B extends A { if, load }"),
    ("class", "class C {}", "C", "class C"),
]
INTERFACES = [
    ("interface", "export interface P { a: string }", "P", "export interface P { a: string }"),
    ("type-alias", "type Q = 'a' | 'b'", "Q", "type Q = 'a' | 'b'"),
    ("interface", "export interface R {\n  first: string;\n  second?: number;\n  readonly third: number;\n" + "  // " + "y" * 200 + "\n}", "R", "export interface R { first, second }"),
    ("type-alias", "declare type S = 1", "S", "interface S"),
]
CONSTANTS = [
    ("constant", "// c\nexport const a = 1", "a", "export const a = 1"),
    ("constant", LONG, "value", LONG.strip()[:150] + "..."),
    ("constant", "/* only */", "b", "const b"),
]


@query(_signatures_sql(FUNCTIONS))
def sig_function(spark, d):
    return _signatures(spark, FUNCTIONS)


@query(_signatures_sql(CLASSES))
def sig_class(spark, d):
    return _signatures(spark, CLASSES)


@query(_signatures_sql(INTERFACES))
def sig_interface(spark, d):
    return _signatures(spark, INTERFACES)


@query(_signatures_sql(CONSTANTS))
def sig_constant(spark, d):
    return _signatures(spark, CONSTANTS)


SOURCES = [
    ("/r/main.ts", "import a from './a';\nimport { b } from \"./b\";\nimport './c';\nconst c = require('./c.js');\n// require( './gone' )\nimport x from 'lodash';\nexport { y } from './a.js';\n"),
    ("/r/a.ts", ""), ("/r/b/index.js", "import up from '../main';"), ("/r/c.js", ""), ("/r/c.ts", ""),
]


@query("""SELECT * FROM (VALUES ('/r/main.ts', './a'), ('/r/main.ts', './b'), ('/r/main.ts', './c'), ('/r/main.ts', './c.js'), ('/r/main.ts', './gone'),
  ('/r/main.ts', 'lodash'), ('/r/b/index.js', '../main')) t(path, specifier)""")
def import_specifiers(spark, d):
    return graph.import_specifiers(_values(spark, SOURCES, "path string, code string"))


@query("""SELECT * FROM (VALUES ('/r/main.ts', './a', '/r/a.ts'), ('/r/main.ts', './b', '/r/b/index.js'), ('/r/main.ts', './c', '/r/c.ts'), ('/r/main.ts', './c.js', '/r/c.js'),
  ('/r/main.ts', './gone', NULL), ('/r/b/index.js', '../main', '/r/main.ts')) t(source_file, specifier, target_file)""")
def import_resolution(spark, d):
    sources = _values(spark, SOURCES, "path string, code string")
    return graph.resolve_imports(graph.import_specifiers(sources), sources.select(F.col("path").alias("file")))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark, d):
    """Link extraction over the pages, as a volume test of the same operator."""
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


SNIPPET = """import fs from 'fs';
/** Adds two. */
export function add(a: number, b: number): { sum: number } {
  function inner() { return '}'; }
  return { sum: a + b };
}
export default function () { return /[}"]/.test('x'); }
// A class.
export class Box<T> extends Base {
  private n = 1;
  constructor(x: T) { super(); }
  get size(): number { return this.n; }
  async load(url: string): Promise<T> { return `${url} }`; }
  static of(x) { return new Box(x); }
}
export const double = (x) => x * 2;
const local = async (y: number): Promise<number> => {
  return y;
};
export const LIMIT = 10, NAME = "a;b";
const hidden = 5;
let later;
interface Shape { area(): number }
export type Id = string | number;
enum Color { Red }
function same() { return 1 }
function same() { return 2 }
"""
EXPECTED = [
    (0, "function", "add"), (1, "function", "anonymous"), (3, "function", "same"), (4, "class", "Box"), (5, "method", "Box.load"), (6, "method", "Box.of"),
    (7, "arrow-function", "double"), (8, "arrow-function", "local"), (9, "constant", "LIMIT"), (10, "constant", "NAME"), (11, "interface", "Shape"), (12, "type-alias", "Id"),
]


@query(f"SELECT * FROM (VALUES {_list(EXPECTED)}) t(ord, type, name)")
def chunk_source(spark, d):
    return chunker.last_wins(chunker.extract(_values(spark, [("/r/x.ts", SNIPPET)], "path string, code string"))).select("ord", "type", "name")


SCANNED = ["src/a.ts", "src/x/b.js", "src/c.tsx", "src/node_modules/d.ts", "lib/e.ts", "src/dist/f.ts", "src/g.d.ts", "dist/h.ts", "src/tmp/i.ts", "src/skip.ts"]


@query("SELECT * FROM (VALUES ('src/a.ts'), ('src/x/b.js'), ('src/g.d.ts')) t(path)")
def scan_files(spark, d):
    return _values(spark, [(p,) for p in SCANNED], "path string").where(scanning.wanted("path", gitignore="tmp/\n/src/skip.ts\n# note\n"))


@query(f"WITH {sql.CHUNKS}, s AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY ord DESC) AS rn FROM chunks) SELECT file, name, ord FROM s WHERE rn = 1")
def chunks_last_wins(spark, d):
    order = Window.partitionBy("file", "name").orderBy(F.desc("ord"))
    return ad.chunks(spark, d).select("file", "name", "ord", F.row_number().over(order).alias("rn")).where("rn = 1").drop("rn")


from ctxspark.plans import generated  # noqa: E402, F401  its queries register themselves
