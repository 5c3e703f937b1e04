"""Queries over sources, paths, logs and entries that Spark generates from the given tables, row for row; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxspark.functions import text as tx
from ctxspark.functions.signature import signature
from ctxspark.operators import budget, chunker, projects, recency, report
from ctxspark.plans import sql
from ctxspark.plans.adapters import table
from ctxspark.plans.catalogue import _list, _scratch, query
from ctxspark.sources import files as scanning
from ctxspark.sources import ignore, sinks
from ctxspark.sources.store import Store

# --- declarations and their signatures: a source for every document

CODE = r"""'import { dep } from ''./dep'';\n/** Step ' || doc_id || '. */\nexport async function fn' || doc_id || '(a: number, b: string): Promise<void> {\n  const inner = () => { return "}"; };\n}\n'
|| 'export class Cls' || doc_id || ' extends Base {\n  constructor(x) {\n  }\n  async run' || doc_id || '(x: string) {\n    return `${x} }`;\n  }\n}\n'
|| '// A constant.\nexport const K' || doc_id || ' = ' || n_chars || ';\nconst arrow' || doc_id || ' = (y) => y;\nconst hidden = 1;\n'
|| 'interface I' || doc_id || ' {\n  first: string;\n}\n'"""
SPARK_CODE, DUCK_CODE = CODE.replace("''", "\\'"), CODE.replace("\\n", "' || chr(10) || '")


def _sources(spark, d):
    return table(spark, d, "documents").select(F.expr("'/src/d' || doc_id || '.ts'").alias("path"), F.expr(SPARK_CODE).alias("code"))


_KINDS = [
    (0, "function", "fn", "'export async function fn' || doc_id || '(a: number, b: string): Promise<void>'"),
    (1, "class", "Cls", "'export class Cls' || doc_id || ' extends Base { run' || doc_id || ' }'"),
    (2, "method", "Cls' || doc_id || '.run", "'async run' || doc_id || '(x: string)'"),
    (3, "constant", "K", "'export const K' || doc_id || ' = ' || n_chars || ';'"),
    (4, "arrow-function", "arrow", "'const arrow' || doc_id || ' = (y) =>'"),
    (5, "interface", "I", "'interface I' || doc_id || ' {' || chr(10) || '  first: string;' || chr(10) || '}'"),
]


@query(" UNION ALL ".join(f"SELECT '/src/d' || doc_id || '.ts' AS path, {o} AS ord, '{k}' AS type, '{n}' || doc_id AS name, {s} AS signature FROM documents" for o, k, n, s in _KINDS))
def chunks_of_sources(spark, d):
    """Declarations of a source for each document, in order, with their signatures."""
    found = chunker.extract(_sources(spark, d)).withColumn("signature", signature("type", "code", "name"))
    return found.select(F.col("file").alias("path"), "ord", "type", "name", "signature")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'export function f(' WHEN 'fr' THEN 'class A' || doc_id || ' { load' || doc_id || ' }'
  WHEN 'de' THEN 'export interface P { a, b' || doc_id || ' }' ELSE 'const v = ''' || repeat('x', 139) || '...' END AS signature FROM documents""")
def signatures_by_kind(spark, d):
    """Signatures where something is in the way: a brace in a parameter, methods among statements, members of long interfaces, long constants."""
    kinds = {
        "en": ("function", r"'// c\n\n/** d */\nexport function f({a, b}, c = {}) {\n}'"),
        "fr": ("class", r"'class A' || doc_id || ' {\n  constructor(x) {\n  }\n  async load' || doc_id || '(y) {\n  }\n  public foo(x) {\n  }\n}'"),
        "de": ("interface", r"'export interface P {\n  a: string;\n  b' || doc_id || '?: number;\n  // ' || repeat('y', 200) || '\n}'"),
        "es": ("constant", r"'/* c */\n  const v = \'' || repeat('x', 200) || '\''"),
    }
    code = kind = None
    for lang, (name, text) in kinds.items():
        code = (F if code is None else code).when(F.col("lang") == lang, F.expr(text))
        kind = (F if kind is None else kind).when(F.col("lang") == lang, name)
    return table(spark, d, "documents").select("doc_id", signature(kind, code, F.lit("name")).alias("signature"))


@query("SELECT doc_id, 'd' || doc_id || '.ts parse http response' || doc_id || ' function f' || doc_id || '(x) Parses ' || lang || '. Twice.' AS text FROM documents")
def searchable_sources(spark, d):
    """Searchable text of declarations with doc comments."""
    code = F.expr(r"'/**\n * Parses ' || lang || '.\n * @param x y\n *\n * Twice. */\nfunction f(x) {}'")
    parts = (F.expr("'/a/d' || doc_id || '.ts'"), F.expr("'parseHTTPResponse' || doc_id"), F.expr("'function f' || doc_id || '(x)'"), code)
    return table(spark, d, "documents").select("doc_id", tx.searchable_text(*parts).alias("text"))


# --- paths: layers, short forms, what is scanned

FOLDERS = ["controllers", "services", "user-dal", "models", "routes", "middleware", "utils", "types", "config", "tests", "pages", "Repository"]
PATH = "'src/' || {folder} || '/' || source || '/' || lang || (doc_id % 40) || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.tsx' END"
SPARK_PATH = PATH.format(folder=f"element_at(array({', '.join(repr(f) for f in FOLDERS)}), int(1 + doc_id % {len(FOLDERS)}))")
DUCK_PATH = PATH.format(folder=f"[{', '.join(repr(f) for f in FOLDERS)}][1 + doc_id % {len(FOLDERS)}]")
#: The same with the folder last, where short paths keep it.
SPARK_DEEP, DUCK_DEEP = (p.replace("'src/' || ", "'src/' || source || '/' || ", 1).replace(" || source || '/' || lang", " || lang", 1) for p in (SPARK_PATH, DUCK_PATH))


def _paths(spark, d, path: str = SPARK_DEEP):
    return table(spark, d, "documents").select("doc_id", F.expr(path).alias("file"))


@query(f"SELECT doc_id, {sql.short(DUCK_DEEP)} AS short, {sql.layer(DUCK_DEEP)} AS layer, {sql.layer(DUCK_DEEP, tx.TOOL_LAYERS)} AS tool_layer FROM documents")
def layers_of_paths(spark, d):
    """Short form and layer of every path, by both lists of layers."""
    own = _paths(spark, d)
    return own.select("doc_id", tx.short_path("file").alias("short"), tx.layer("file").alias("layer"), tx.layer("file", tx.TOOL_LAYERS).alias("tool_layer"))


def _rollup(rules) -> str:
    return f"""WITH s AS (SELECT DISTINCT {sql.short(DUCK_DEEP)} AS file FROM documents), l AS (SELECT file, {sql.layer('file', rules)} AS layer FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY file) AS rn FROM l)
    SELECT layer, count(*) AS files, string_agg(file, ', ' ORDER BY file) FILTER (rn <= 8) AS listed FROM r GROUP BY layer"""


@query(_rollup(tx.LAYERS))
def layers_rollup(spark, d):
    return report.layers(_paths(spark, d))


@query(_rollup(tx.TOOL_LAYERS))
def tool_layers_rollup(spark, d):
    return report.tool_layers(_paths(spark, d))


@query(f"""SELECT DISTINCT path FROM (SELECT lang, doc_id, {DUCK_PATH} AS path FROM documents)
WHERE (suffix(path, '.ts') OR suffix(path, '.js')) AND NOT contains(path, '/tests/') AND (NOT contains(path, '/config/') OR contains(path, '/src7/'))
  AND (NOT regexp_matches(path, '/en[0-9]*\\.js$') OR contains(path, '/services/'))""")
def scanned_paths(spark, d):
    """Paths that are wanted, after ignore files of the root and of two folders: folders, negation, the last match, the nearest file."""
    texts = [("", "**/tests/\nen*.js\nsrc/config/*\n!src/config/src7\n"), ("src/services", "!en*.js\n"), ("src/tests", "!*\n")]
    rules = ignore.rules(spark.createDataFrame(texts, "dir string, text string"))
    paths = _paths(spark, d, SPARK_PATH).select(F.col("file").alias("path")).where(scanning.wanted("path")).distinct()
    return paths.join(ignore.ignored(paths, rules, "path"), "path", "left_anti")


LISTED = [
    "package.json", "tsconfig.json", "src/index.ts", "packages/a/x.ts", "controllers/a.js", "services/b.ts", "go.mod", "jest.config.js", "lib/x.py", "src/deep/a.go",
    "features/f.ts", "components/c.js", "lerna.json", "Cargo.toml", "server.js", "main.ts", "pyproject.toml", "src/x.rb", "README.md", "models/m.ts", "a.sln",
]


def _has(*paths: str) -> str:
    return f"list_has_any(p, [{', '.join(map(repr, paths))}])"


@query(f"""WITH l AS (SELECT source || '-' || lang AS project, list(DISTINCT [{', '.join(map(repr, LISTED))}][1 + (doc_id * 5) % {len(LISTED)}]) AS p FROM documents GROUP BY 1),
m AS (SELECT *, list_filter([
  CASE WHEN {_has('package.json', 'tsconfig.json')} THEN 'javascript' END, CASE WHEN {_has('tsconfig.json', 'main.ts')} THEN 'typescript' END,
  CASE WHEN {_has('pyproject.toml')} THEN 'python' END, CASE WHEN {_has('go.mod')} THEN 'go' END, CASE WHEN {_has('Cargo.toml')} THEN 'rust' END,
  CASE WHEN {_has('a.sln')} THEN 'csharp' END], lambda x: x IS NOT NULL) AS marked,
  list_filter([CASE WHEN {_has('src/index.ts')} THEN 'typescript' END, CASE WHEN {_has('src/deep/a.go')} THEN 'go' END, CASE WHEN {_has('src/x.rb')} THEN 'ruby' END], lambda x: x IS NOT NULL) AS found FROM l)
SELECT project, array_to_string(CASE WHEN len(marked) > 0 THEN marked ELSE found END, ',') AS language,
  CASE WHEN {_has('packages/a/x.ts', 'services/b.ts')} THEN CASE WHEN {_has('lerna.json')} THEN 'monorepo' ELSE 'multi-package' END
       WHEN {_has('controllers/a.js', 'components/c.js')} THEN CASE WHEN {_has('services/b.ts', 'models/m.ts')} THEN 'mvc-layered' ELSE 'component-based' END
       WHEN {_has('features/f.ts')} THEN 'feature-based' WHEN {_has('src/index.ts', 'src/deep/a.go', 'src/x.rb')} THEN 'src-based' ELSE 'flat' END AS structure,
  array_to_string(list_filter([CASE WHEN {_has('src/index.ts')} THEN 'src/index.ts' END, CASE WHEN {_has('server.js')} THEN 'server.js' END], lambda x: x IS NOT NULL), ',') AS entries,
  CASE WHEN {_has('jest.config.js')} THEN '**/*.test.ts' WHEN {_has('pyproject.toml')} THEN 'tests/**/*.py' ELSE 'test/**' END AS first_tests,
  CASE WHEN {_has('package.json')} THEN 'express,' || CASE WHEN lang_en THEN 'react,' ELSE '' END || 'prisma' ELSE '' END AS framework
FROM (SELECT *, suffix(project, '-en') AS lang_en FROM m)""")
def projects_of_listings(spark, d):
    """Profiles of a project per source and language, from listings and package files."""
    docs = table(spark, d, "documents")
    path = F.expr(f"element_at(array({', '.join(map(repr, LISTED))}), int(1 + (doc_id * 5) % {len(LISTED)}))")
    listing = docs.select(F.concat_ws("-", "source", "lang").alias("project"), "lang", path.alias("path"))
    text = F.concat(F.lit('{"dependencies": {"express": "4", "left-pad": "1"'), F.when(F.col("lang") == "en", ', "react": "18"').otherwise(""), F.lit('}, "devDependencies": {"@prisma/client": "5", "vue": ""}}'))
    packages = listing.where("path = 'package.json'").select("project", text.alias("text")).distinct()
    found = projects.profiles(listing, packages)
    joined = [F.array_join(c, ",").alias(n) for c, n in (("language", "language"), ("framework", "framework"), ("entryPoints", "entries"))]
    return found.select("project", "structure", *joined, F.get("testPatterns", F.lit(0)).alias("first_tests"))


# --- budgets

MODELS = ["gpt-4o", "gpt-4o-mini", "o3-mini-2025", "Claude-3.5-Sonnet", "claude-3-opus", "llama-3-70b-instruct", "unknown", "Mixtral-8x7b"]


def _budgets(model: str) -> str:
    arms = " ".join(f"WHEN contains(lower({model}), '{name}') THEN {n}" for name, n in budget.MODEL_BUDGETS)
    return f"CASE {arms} ELSE {budget.DEFAULT_BUDGET} END"


@query(f"SELECT c_custkey, {_budgets(f'[{', '.join(map(repr, MODELS))}][1 + c_custkey % {len(MODELS)}]')} AS budget FROM customer")
def budgets_of_models(spark, d):
    model = F.expr(f"element_at(array({', '.join(map(repr, MODELS))}), int(1 + c_custkey % {len(MODELS)}))")
    return table(spark, d, "customer").select("c_custkey", budget.model_budget(model).alias("budget"))


@query(f"""WITH RECURSIVE e AS (
  SELECT o_custkey AS c, o_orderkey::VARCHAR AS id, {sql.estimate("repeat('word ', 1 + o_orderkey % 7)")} AS cost,
         row_number() OVER (PARTITION BY o_custkey ORDER BY -(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.5::DOUBLE ELSE o_totalprice END), o_orderkey::VARCHAR) AS rn FROM orders),
f AS (
  SELECT c, 0::BIGINT AS rn, 0::BIGINT AS total, []::VARCHAR[] AS kept, 0::BIGINT AS dropped FROM (SELECT DISTINCT c FROM e)
  UNION ALL SELECT f.c, e.rn, CASE WHEN f.total + e.cost <= 20 THEN f.total + e.cost ELSE f.total END,
    CASE WHEN f.total + e.cost <= 20 THEN list_append(f.kept, e.id) ELSE f.kept END, CASE WHEN f.total + e.cost <= 20 THEN f.dropped ELSE f.dropped + 1 END
  FROM f JOIN e ON e.c = f.c AND e.rn = f.rn + 1)
SELECT c AS o_custkey, arg_max(array_to_string(kept, ','), rn) AS kept, arg_max(total, rn) AS total_tokens, floor(arg_max(total, rn) / 20.0 * 100 + 0.5)::BIGINT AS budget_used,
       arg_max(dropped, rn) AS dropped FROM f GROUP BY c""")
def packs_of_orders(spark, d):
    """Greedy packing of each customer's orders, best first with boosted ones, skipping what doesn't fit."""
    source = F.when(F.col("o_orderstatus") == "F", "graph").otherwise("search")
    text = F.expr("repeat('word ', int(1 + o_orderkey % 7))")
    entries = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"), text.alias("text"), F.col("o_totalprice").alias("score"), source.alias("source"))
    return budget.pack_greedy(entries, 20, ["o_custkey"]).withColumn("kept", F.array_join("kept", ","))


# --- logs, stores, output


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000000 END AS stamp FROM events),
c AS (SELECT *, count(stamp) OVER (PARTITION BY user_id ORDER BY event_id) AS commit_ord FROM l),
t AS (SELECT *, max(stamp) OVER (PARTITION BY user_id, commit_ord) AS committed FROM c)
SELECT user_id, commit_ord::INTEGER AS commit_ord, committed::BIGINT AS committed, 'src/f' || (event_id % 17) || '.ts' AS path FROM t WHERE stamp IS NULL AND committed IS NOT NULL""")
def logs_of_events(spark, d):
    """Commit logs of many projects, one per user: heads carry their time to the paths below them."""
    head = F.concat_ws(" ", F.unix_seconds(F.col("ts").cast("timestamp")), F.hex(F.col("event_id") + 4096))
    line = F.when(F.expr("event_id % 4 = 0"), F.lower(head)).otherwise(F.expr("'src/f' || (event_id % 17) || '.ts'"))
    lines = table(spark, d, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    parsed = recency.parse_log(lines, ["user_id"])
    return parsed.select("user_id", F.col("commit_ord").cast("int").alias("commit_ord"), F.unix_seconds("ts").alias("committed"), "path")


@query("SELECT min(c_name) AS path, min(c_acctbal) AS mtime FROM customer WHERE c_custkey = 77")
def store_lookup(spark, d):
    """One row of a stored table by its key, from its bucket."""
    own = Store(spark, _scratch(spark))
    own.upsert("files", table(spark, d, "customer").select(F.col("c_name").alias("path"), F.col("c_acctbal").alias("mtime"), F.lit("").alias("hash")))
    key = table(spark, d, "customer").where("c_custkey = 77").first()["c_name"]
    return own.lookup("files", key).select("path", "mtime")


@query("SELECT n_name AS source_file, r_name AS target_file FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def graph_replaced(spark, d):
    """A saved graph, replaced by another, after all tables were cleared."""
    own, nation, region = Store(spark, _scratch(spark)), table(spark, d, "nation"), table(spark, d, "region")
    edges = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("source_file"), F.col("r_name").alias("target_file"), "n_nationkey")
    own.save_graph(edges)
    own.clear()
    own.save_graph(edges.where("n_nationkey % 2 = 1"))
    own.save_graph(edges.where("n_nationkey % 2 = 0"))
    return own.table("graph")


@query("SELECT c_mktsegment AS path, count(*)::DOUBLE AS mtime FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def store_file_removed(spark, d):
    """Tracked files without one that was removed."""
    own = Store(spark, _scratch(spark))
    own.upsert("files", table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("path")).agg(F.count("*").cast("double").alias("mtime")).withColumn("hash", F.lit("")))
    own.remove_file("BUILDING")
    return own.table("files").select("path", "mtime")


@query(f"SELECT p_partkey::VARCHAR AS id, printf('[%.4f] %s  %s  %s', p_retailprice, p_name, {sql.short('p_type')}, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END) AS line FROM part")
def result_lines(spark, d):
    """Results as lines of text; a name stands for an empty signature."""
    part = table(spark, d, "part")
    signed = F.when(F.expr("p_size % 2 = 0"), F.col("p_brand")).otherwise("")
    return sinks.lines(part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("file"), F.col("p_name").alias("name"), signed.alias("signature"), F.col("p_retailprice").alias("score")))


@query("""SELECT '# Nations' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY block) AS markdown FROM (
  SELECT '## ' || r_name || chr(10) || string_agg('- **' || n_name || '**: `' || n_name || '`', chr(10) ORDER BY n_nationkey) AS block
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def result_markdown(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    entries = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return sinks.as_markdown(entries.select(F.col("r_name").alias("section"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("file"), F.lit("").alias("signature"), F.col("n_name").alias("name")), "Nations")


@query(f"SELECT s_suppkey, {sql.human('s_name')} AS human, upper(s_name[1:1]) || s_name[2:] AS capital, ceil(len(s_name) / 4.0)::BIGINT + 10 AS tokens FROM supplier")
def names_of_suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", tx.human_name("s_name").alias("human"), tx.capitalised("s_name").alias("capital"), tx.quarter_tokens("s_name").alias("tokens"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM e WHERE rn = 1 GROUP BY user_id""")
def first_seen_lists(spark, d):
    """Lists without repeats, in the order of first occurrence."""
    first = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    kept = table(spark, d, "events").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return kept.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("l")).select("user_id", F.array_join("l.event_type", ",").alias("types"))
