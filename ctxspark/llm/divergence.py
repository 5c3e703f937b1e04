"""Source divergence audit: how the words of each source differ from other sources and from all of its language.

Texts are counted where they are read: DuckDB sums (lang, source, term) over a task's Arrow batches, and only these sums are shuffled. Rows are
hashed by lang and term into shards, so a shard holds all there is of a term in a language; DuckDB keeps the terms of enough documents there, and
in a second pass adds up partial pair sums and ranks the shard's terms. Spark merges sums and ranks.

A share is p(c) = 1 + floor(SCALE * (c + 2) / (N + 2 V)), a divergence f(p, q) = floor((p - q)^2 / (p + q)); everything is an integer. Most sources
lack most terms, so a pair's sum over all V terms is not taken term by term. With p0 = p(0), and for the sources g and h,

    sum f = sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]      (partial sums of the shards)
          + sum over terms of g [f(p, q0)] + sum over terms of h [f(p0, q)]         (from how many terms have which count, merged by Spark)
          + (V - terms of g - terms of h) f(p0, q0)

which is the same number. Work is that of the pairs of sources that share a term, and none is ever written out pair by pair and term by term.

A very frequent term has one row for each task and source. Pairs of sources are what is asked for, so the result grows with their square.
DuckDB has one thread and `MEMORY` in each task and spills to the task's own folder, which goes with it.

Defined results: null text, lang and source are ''; a text without terms still makes its group occur; repeated rows count as documents of their
own; bytes that are no UTF-8 count as U+FFFD; a very long text is counted whole; equal values are ranked by item; a language without kept
terms has pairs of value 0 and no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm import common

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
MEMORY = "250MB"
#: Rows of sums after which a task passes on what it has.
MAX_SUMS = 1_000_000
#: Groups of lang and source up to which their totals are broadcast.
BROADCAST_GROUPS = 100_000

SUMS = "lang string, source string, term string, n long, docs long"
COUNTS = "lang string, source string, term string, n long, total long, is_first boolean"
PARTS = "lang string, source string, part string, item string, value long"


def _table() -> bytes:
    """Bytes of a text: letters A-Z lower-cased, what separates terms to a space, all else as it is."""
    low = bytes(range(0x41)), bytes(range(0x5B, 0x61)), bytes(range(0x7B, 0x80))
    gaps = b"".join(low)
    upper = bytes(range(0x41, 0x5B))
    return bytes.maketrans(gaps + upper, b" " * len(gaps) + upper.lower())


def _text(text: bytes) -> bytes:
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            return text.decode("utf-8", "replace").encode()
    return text


class _Duck:
    """A DuckDB connection of one task."""

    def __enter__(self):
        import tempfile

        import duckdb

        self.folder = tempfile.TemporaryDirectory()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        return self.con

    def __exit__(self, *_) -> None:
        self.con.close()
        self.folder.cleanup()
        common.release()


def _rows(con, sql: str, schema: str):
    """Result of a query as record batches of plain types."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    target = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    for batch in con.sql(sql).to_arrow_reader(65_536):
        yield batch.cast(target)


def _load(con, batches, schema: str) -> None:
    import pyarrow as pa

    con.execute(f"CREATE TABLE part ({schema.replace(' string', ' VARCHAR').replace(' long', ' BIGINT')})")
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute("INSERT INTO part SELECT * FROM batch")


def _sum_texts(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = _table()
    grouped = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL"
    with _Duck() as con:
        _load(con, (), SUMS)
        for batch in batches:
            lang, source = (pa.array([_text(x) for x in common.texts(batch.column(k))]).cast(pa.string()) for k in (0, 1))
            texts = pa.array([_text(x).translate(table) for x in common.texts(batch.column(2))], pa.large_binary()).cast(pa.large_string())
            split = pc.ascii_split_whitespace(texts)
            words = split.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(batch), dtype=np.int32), np.diff(split.offsets.to_numpy()))
            con.register("words", pa.table({"doc": doc, "word": words.indices}))
            con.register("dictionary", pa.table({"word": np.arange(len(words.dictionary), dtype=np.int32), "term": words.dictionary}))
            con.register("batch", pa.table({"doc": np.arange(len(batch), dtype=np.int32), "lang": lang, "source": source}))
            con.execute(
                """INSERT INTO part
                SELECT lang, source, term, sum(n), count(*) FROM (SELECT doc, word, count(*) AS n FROM words GROUP BY ALL)
                JOIN dictionary USING (word) JOIN batch USING (doc) WHERE term <> '' GROUP BY ALL
                UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM batch"""
            )
            if con.execute("SELECT count(*) FROM part").fetchall()[0][0] > MAX_SUMS:
                con.execute(f"CREATE OR REPLACE TABLE less AS {grouped}")
                con.execute("DELETE FROM part")
                if con.execute("SELECT count(*) FROM less").fetchall()[0][0] > MAX_SUMS // 2:
                    yield from _rows(con, "FROM less", SUMS)
                else:
                    con.execute("INSERT INTO part FROM less")
                con.execute("DROP TABLE less")
        yield from _rows(con, grouped, SUMS)


def _count_shard(min_docs: int):
    def run(batches):
        with _Duck() as con:
            _load(con, batches, SUMS)
            sql = f"""
            WITH own AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM part GROUP BY ALL),
            terms AS (SELECT lang, term, sum(n)::BIGINT AS total, min(source) AS least FROM own GROUP BY ALL HAVING term = '' OR sum(docs) >= {min_docs})
            SELECT lang, source, term, n, total, source = least AS is_first FROM own JOIN terms USING (lang, term)"""
            yield from _rows(con, sql, COUNTS)

    return run


#: What a shard gets: shares of a term in its group and language, and the group's share of a missing term.
SHARES = "lang string, source string, term string, p long, q long, p0 long"


def _divergence(p: str, q: str) -> str:
    """The same in DuckDB."""
    return f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"


def _compare_shard(batches):
    with _Duck() as con:
        _load(con, batches, SHARES)
        f = _divergence
        yield from _rows(
            con,
            f"""SELECT lang, source, 'term' AS part, item, value FROM (
              SELECT lang, source, term AS item, {f("p", "q")} AS value, row_number() OVER (PARTITION BY lang, source ORDER BY {f("p", "q")} DESC, term) AS rank
              FROM part WHERE p > q) WHERE rank <= {TOP}""",
            PARTS,
        )
        # each pair once; Spark turns it round
        yield from _rows(
            con,
            f"""SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item,
                sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::BIGINT AS value
            FROM part a JOIN part b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""",
            PARTS,
        )


def share(count: str, total: str, terms: str):
    """p(c); null where there are no terms at all."""
    whole = f"cast({count} as decimal(20,0)) + 2", f"nullif(cast({total} as decimal(20,0)) + 2 * cast({terms} as decimal(20,0)), 0)"
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * ({whole[0]})) div ({whole[1]})")


def divergence(p: str, q: str):
    """f(p, q); 0 where there are no terms."""
    return F.expr(f"coalesce((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})), 0L)")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, shards: int | None = None) -> DataFrame:
    """lang, source, term, n, total (in the language), is_first (one row of each lang and term): kept terms, and term '' for each group; dealt by shards."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    plain = docs.select(*[F.col(c).cast("string").alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))])
    sums = plain.mapInArrow(common.tidy(_sum_texts), SUMS)
    dealt = sums.repartition(shards, "lang", "term") if shards else sums.repartition("lang", "term")
    return dealt.mapInArrow(common.tidy(_count_shard(min_docs)), COUNTS)


def audit(counts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank from term_counts, cut before: it is read four times."""
    by_lang = Window.partitionBy("lang")
    groups = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("big_n"), F.count_if(F.expr("is_first and term <> ''")).alias("firsts"), F.count_if(F.expr("n > 0")).alias("terms")
    )
    groups = groups.withColumns({"v": F.sum("firsts").over(by_lang), "lang_n": F.sum("big_n").over(by_lang)}).withColumn("p0", share("0", "big_n", "v"))
    groups = common.cut(groups.drop("firsts"))
    few = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if few else (lambda df: df)
    on_group = [F.col("c.lang") == F.col("g.lang"), F.col("c.source") == F.col("g.source")]
    # shards: a broadcast keeps rows where they are
    joined = counts.where("n > 0").alias("c").join(hint(groups.alias("g")), on_group)
    shares = joined.select("c.lang", "c.source", "term", share("n", "big_n", "v").alias("p"), share("total", "lang_n", "v").alias("q"), "p0")
    found = common.cut((shares if few else shares.repartition("lang", "term")).mapInArrow(common.tidy(_compare_shard), PARTS))

    # terms of one source alone: how many have which count
    alike = counts.where("n > 0").groupBy("lang", "source", "n").agg(F.count("*").alias("m")).alias("c").join(hint(groups.alias("g")), on_group)
    alike = alike.select("c.lang", "c.source", "m", share("n", "big_n", "v").alias("p")).alias("a")
    other = groups.alias("h")
    one_sided = alike.join(hint(other), F.expr("a.lang = h.lang and a.source <> h.source"))
    one_sided = one_sided.select("a.lang", "a.source", F.col("h.source").alias("item"), (F.col("m") * divergence("a.p", "h.p0")).alias("value"))
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    missing = groups.alias("g").join(hint(other), F.expr("g.lang = h.lang and g.source <> h.source"))
    missing = missing.select(
        "g.lang", "g.source", F.col("h.source").alias("item"), (F.expr("g.v - g.terms - h.terms") * divergence("g.p0", "h.p0")).alias("value")
    )
    shared = found.where("part = 'pair'").select("lang", "source", "item", "value")
    turn = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = missing.union(one_sided).union(turn(one_sided)).union(shared).union(turn(shared))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # ranked apart, so that what is beyond the top is left out before the shuffle
    terms = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return terms.unionByName(pairs.withColumn("rank", ranked)).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(common.cut(term_counts(common.table(spark, sf_dir, "documents"))))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total, count(*) OVER g AS v, sum(coalesce(n, 0)) OVER g AS big_n, sum(total) OVER g AS lang_n
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term) WINDOW g AS (PARTITION BY lang, source)),
shares AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (big_n + 2 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 2) // (lang_n + 2 * v))::BIGINT AS q
  FROM grid),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
