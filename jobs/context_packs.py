"""Context packs for many questions at once.

A search answers one question; teams that prepare prompts, or measure retrieval, have a table of them. The job ranks all documents for
each question by BM25, takes the best, writes them as one line each (where a document is from, and its first line), and keeps lines
from the best one down as long as their token estimates fit the budget. Output is partitioned by a bucket of the question.

A run replaces the whole output, so running again leaves the same rows. doc_id and the question's id are taken to be unique; rows without them are left
out. A question without terms, or without a document that has one of them, gets no rows; so does one whose first line overflows the budget.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import estimate_tokens, tokenize
from ctxspark.operators import bm25
from ctxspark.plans import sql
from ctxspark.session import spread
from jobs import common

log = logging.getLogger("context_packs")

PACKS = "question long, position int, doc_id long, score double, line string, cost long, used long, bucket int"
MAX_LINE = 150


def packs(documents: DataFrame, questions: DataFrame, top: int, budget: int) -> DataFrame:
    """question, position, doc_id, score, line, cost, used. documents: doc_id, text, lang, source; questions: question, text."""
    docs = documents.where("doc_id is not null")
    own = docs.select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    asked = questions.where("question is not null").select("question", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    best = bm25.top_documents(own, asked, top, "doc_id").checkpoint()  # questions times top rows
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    cut = F.when(F.length(first) > MAX_LINE, F.concat(F.substring(first, 1, MAX_LINE), F.lit("..."))).otherwise(first)
    line = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit(": "), cut)
    # texts stay where they are: the few rows found go to them, if they are few
    lines = docs.select(F.col("doc_id").alias("id"), line.alias("line")).join(bm25.sent(best), "id")
    costed = lines.withColumn("cost", estimate_tokens("line"))
    order = Window.partitionBy("question").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = costed.withColumn("used", F.sum("cost").over(order)).where(F.col("used") <= budget)
    return kept.select("question", F.col("rank").alias("position"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "line", "cost", "used")


def run(
    spark: SparkSession, documents: str, questions: str, output: str, question_id: str = "item_id", question_text: str = "text",
    top: int = 10, budget: int = 300, buckets: int = 8,
) -> DataFrame:
    """Write the packs of all questions; returns them read back."""
    docs, asked = spread(spark.read.parquet(documents)), spark.read.parquet(questions)
    asked = asked.select(F.col(question_id).cast("long").alias("question"), F.col(question_text).cast("string").alias("text"))
    log.info("reading %d documents of %s and %d questions of %s", docs.count(), documents, asked.count(), questions)
    found = packs(docs, asked, top, budget).withColumn("bucket", F.pmod("question", F.lit(buckets)).cast("int"))
    dealt = found.repartition("bucket", "question").sortWithinPartitions("bucket", "question", "position")
    # the whole output is replaced, so that no partition of an earlier run stays behind
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(output)
    written = spark.read.schema(PACKS).parquet(output)
    counts = written.agg(F.count("*").alias("n"), F.count_distinct("question").alias("q")).first()
    log.info("wrote %d lines for %d questions to %s", counts["n"], counts["q"], output)
    return written


def job2_context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice, with the items of benchmark as questions to all documents, into a new folder."""
    folder = common.new_folder(spark, "job2")
    for _ in range(2):
        found = run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/packs")
    return found.drop("bucket")


_LINE = f"""coalesce(source, '') || '/' || coalesce(lang, '') || ': ' ||
  CASE WHEN len(split_part(coalesce(text, ''), chr(10), 1)) > {MAX_LINE} THEN split_part(text, chr(10), 1)[1:{MAX_LINE}] || '...' ELSE split_part(coalesce(text, ''), chr(10), 1) END"""
SQL = f"""
WITH toks AS (SELECT doc_id, {sql.tokens("coalesce(text, '')")} AS t FROM documents WHERE doc_id IS NOT NULL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
asked AS (SELECT question, term, count(*) AS times FROM (SELECT item_id AS question, unnest({sql.tokens("coalesce(text, '')")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM toks) SEMI JOIN asked USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT question, doc_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), st GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS position FROM scored),
lines AS (SELECT question, position, doc_id, round(score, 6) AS score, {_LINE} AS line FROM ranked JOIN documents USING (doc_id) WHERE position <= 10),
costed AS (SELECT *, {sql.estimate('line')} AS cost FROM lines),
run AS (SELECT *, sum(cost) OVER (PARTITION BY question ORDER BY position)::BIGINT AS used FROM costed)
SELECT question, position, doc_id, score, line, cost, used FROM run WHERE used <= 300
"""

if __name__ == "__main__":
    common.main("context packs", run, common.settings(__doc__, ["documents", "questions", "output"]))
