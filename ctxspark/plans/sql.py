"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from ctxspark.functions.text import LAYERS, STOP_WORDS, TOOL_LAYERS
from ctxspark.plans.adapters import FILE, NOW, QUERY

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def camel(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({camel(x)}), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: len(w) > 1 AND w NOT IN ({STOPS}))"


def human(x: str) -> str:
    return rf"lower(regexp_replace({camel(x)}, '\.', ' ', 'g'))"


def name_parts(x: str) -> str:
    return rf"string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '\.', ' ', 'g')), '\s+')"


def estimate(x: str) -> str:
    cost = "CASE WHEN len(w) <= 4 THEN 1 WHEN len(w) <= 10 THEN 2 WHEN len(w) <= 20 THEN 3 ELSE ceil(len(w) / 6)::BIGINT END"
    words = rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"
    breaks = f"ceil((len({x}) - len(replace({x}, chr(10), ''))) * 0.5)::BIGINT"
    return f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, coalesce(list_sum(list_transform({words}, lambda w: {cost})), 0)::BIGINT + {breaks}) END)::BIGINT"


def short(x: str) -> str:
    return rf"array_to_string(list_slice(regexp_split_to_array({x}, '[/\\]'), -2, -1), '/')"


def layer(x: str, rules=LAYERS) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'''contains(lower({x}), '{w}')''' for w in words)} THEN '{name}'" for words, name in rules)
    return f"CASE {arms} ELSE 'other' END"


def cosine(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) <> len({b}) OR len({a}) = 0 OR list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0"
        f" ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"
    )


CHUNKS = f"""
raw AS (
  SELECT 'src/' || source || '/' || lang || '.ts' AS file, regexp_extract(text, '^[^ \\n]+', 0) AS name, doc_id AS ord, lang, text AS code,
         CASE WHEN len(split_part(text, chr(10), 1)) > 150 THEN split_part(text, chr(10), 1)[1:150] || '...' ELSE split_part(text, chr(10), 1) END AS signature
  FROM documents),
chunks AS (
  SELECT file || '#' || ord AS id, file, CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'class' WHEN 'de' THEN 'method' ELSE 'interface' END AS type,
         name, signature, code, md5(code) AS hash, lang || '.ts ' || {human('name')} || ' ' || signature AS summary, ord
  FROM raw)"""

FILES = """
files AS (SELECT doc_id, 'src/' || source || '/' || lang || '.ts' AS file FROM documents)"""

EDGES = f"""{FILES},
edges AS (
  SELECT DISTINCT a.file AS source_file, b.file AS target_file
  FROM files a JOIN files b ON (a.doc_id * 7 + 3) % (SELECT count(*) FROM documents) = b.doc_id WHERE a.file <> b.file)"""


def ranks(nodes: str = "SELECT source_file AS file FROM edges UNION SELECT target_file FROM edges") -> str:
    steps = [
        f"pr_nodes AS ({nodes})",
        "pr_n AS (SELECT count(*)::DOUBLE AS n FROM pr_nodes)",
        "pr_links AS (SELECT source_file, target_file, count(*) OVER (PARTITION BY source_file) AS degree FROM edges)",
        "pr0 AS MATERIALIZED (SELECT file, 1 / n AS rank FROM pr_nodes, pr_n)",
    ]
    for i in range(1, 21):
        steps.append(
            f"pr{i} AS MATERIALIZED (SELECT x.file, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM pr_nodes x CROSS JOIN pr_n"
            f" LEFT JOIN (SELECT target_file, sum(r.rank / degree) AS given FROM pr_links l JOIN pr{i - 1} r ON l.source_file = r.file GROUP BY target_file) g"
            f" ON g.target_file = x.file)"
        )
    return ",\n".join([*steps, "ranks AS (SELECT file, rank FROM pr20)"])


LATEST = f"""{FILES},
commits AS (
  SELECT f.file AS path, e.ts FROM events e JOIN files f ON e.event_id % (SELECT count(*) FROM documents) = f.doc_id WHERE e.event_type <> 'error'),
latest AS (SELECT path, max(ts) AS ts FROM commits GROUP BY path),
recent AS (SELECT path AS file, exp(-(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 / 86400.0 / 10.0) AS recency FROM latest)"""


def bm25(source: str = "chunks", text: str = "name || ' ' || signature || ' ' || summary", key: str = "id", query: str = QUERY) -> str:
    """bm (key, score) of all rows of source; terms of the query with repeats."""
    return f"""
toks AS (SELECT {key} AS key, {tokens(text)} AS t FROM {source}),
q AS (SELECT unnest({tokens(f"'{query}'")}) AS term),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
df AS (SELECT term, (SELECT count(*) FROM toks WHERE list_contains(t, term)) AS df FROM (SELECT DISTINCT term FROM q)),
tf AS (SELECT key, len(t)::DOUBLE AS dl, q.term, len(list_filter(t, lambda w: w = q.term))::DOUBLE AS tf FROM toks, q),
bm AS (
  SELECT key, sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) ELSE 0 END) AS score
  FROM tf JOIN df USING (term), st GROUP BY key)"""


def matches(name: str, query: str = QUERY) -> str:
    return f"len(list_filter({tokens(f'''{chr(39)}{query}{chr(39)}''')}, lambda q: len(list_filter({name_parts(name)}, lambda p: contains(p, q))) > 0))"


def hybrid(embedding: bool = True, weights=(0.30, 0.40, 0.10, 0.10, 0.10)) -> str:
    """hy (id, file, name, signature, score) of all chunks."""
    b, e, p, m, r = (f"{w}::DOUBLE" for w in weights)
    similar = cosine("v.embedding::DOUBLE[]", "qv.embedding::DOUBLE[]") if embedding else "0"
    edges_only = EDGES.replace(FILES + ",", "")
    return f"""{CHUNKS}, {LATEST}, {edges_only.lstrip()},
{ranks()}, {bm25()},
qv AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
hy AS (
  SELECT c.id, c.file, c.name, c.signature, c.ord,
         {b} * (bm.score / greatest((SELECT max(score) FROM bm), 0.001)) + {e} * coalesce({similar}, 0)
         + {p} * coalesce(k.rank / greatest((SELECT max(rank) FROM ranks), 0.001), 0) + {r} * coalesce(t.recency, 0) + {m} * {matches('c.name')} AS score
  FROM chunks c JOIN bm ON bm.key = c.id LEFT JOIN embeddings v ON v.vec_id = c.ord LEFT JOIN ranks k ON k.file = c.file LEFT JOIN recent t ON t.file = c.file, qv)"""


NEIGHBOURS = f"""
near AS (
  SELECT target_file AS file FROM edges WHERE source_file = '{FILE}' UNION SELECT source_file FROM edges WHERE target_file = '{FILE}' UNION SELECT '{FILE}')"""
TOOL_LAYER = layer("file", TOOL_LAYERS)
