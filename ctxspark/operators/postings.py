"""The inverted index in its stored form: one row per term and file, with what bounds its scores.

A row (a block) has a file's documents that contain the term, how many they are, their greatest term frequency, and their least and greatest
length. BM25 grows with the frequency and falls with the length, so for any mean length

    no document of the block scores above  norm(max_tf, min_dl),  and one of them scores at least  norm(max_tf, max_dl).

The k-th greatest of the files' lower bounds is a score that k documents reach. A file whose upper bounds add up to less can't have one of the k
best, and its blocks aren't opened. The result is that of all scores, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.operators import bm25 as bm

#: A bound must not fall below a score by rounding.
SLACK = 1e-9


def blocks(docs: DataFrame, file: str = "file", doc_id: str = "id", tokens: str = "tokens") -> DataFrame:
    """(file, term, n, max_tf, min_dl, max_dl, found) of documents with tokens; a block is no longer than its file."""
    each = docs.select(F.col(file).alias("file"), F.col(doc_id).cast("string").alias("id"), F.size(tokens).alias("dl"), F.explode(bm.term_counts(tokens)).alias("p"))
    each = each.select("file", "id", "dl", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
    return each.groupBy("file", "term").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"),
        F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("found"),
    )


def norm(tf, dl, mean: float):
    return F.expr(tf).cast("double") * (bm.K1 + 1) / (F.expr(tf) + bm.K1 * (1 - bm.B + bm.B * (F.expr(dl) / F.lit(mean))))


def weighted(blocks: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Blocks of the query's terms with `weight`: how often the query has the term, times its inverse document frequency."""
    times = {t: terms.count(t) for t in terms}
    asked = F.broadcast(blocks.sparkSession.createDataFrame(list(times.items()) or [("", 0)], "term string, times int"))  # a query's terms
    hits = blocks.where(F.col("term").isin(*times))
    df = F.broadcast(hits.groupBy("term").agg(F.sum("n").alias("df")))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return hits.join(asked, "term").join(df, "term").withColumn("weight", F.col("times") * idf)


def _summed(hits: DataFrame, mean: float) -> DataFrame:
    opened = hits.select("file", "weight", F.explode("found").alias("d")).withColumns({"tf": F.col("d.tf"), "dl": F.col("d.dl")})
    return opened.groupBy(F.col("d.id").alias("id")).agg(F.sum(F.col("weight") * norm("tf", "dl", mean)).alias("score"))


def scores(blocks: DataFrame, terms: list[str], n: int, mean: float) -> DataFrame:
    """(id, score) of every document that has one of the terms. n, mean: documents, and their mean length."""
    return _summed(weighted(blocks, terms, n), mean or 1.0)


def candidates(hits: DataFrame, k: int, mean: float) -> DataFrame:
    """(file): those that may have one of the k best documents, from the blocks' bounds alone."""
    above, below = F.col("weight") * norm("max_tf", "min_dl", mean), F.col("weight") * norm("max_tf", "max_dl", mean)
    files = hits.groupBy("file").agg(F.sum(above).alias("above"), F.max(below).alias("below"))
    # k rows, then one; with fewer than k files nothing is left out
    best = files.select("below").orderBy(F.desc("below")).limit(k).agg(F.min("below").alias("least"), F.count("*").alias("n"))
    return files.join(F.broadcast(best)).where((F.col("n") < k) | (F.col("above") >= F.col("least") - SLACK)).select("file")


def top_k(blocks: DataFrame, terms: list[str], k: int, n: int, mean: float) -> DataFrame:
    """The k best (id, score), equal to nine places by id."""
    mean = mean or 1.0
    hits = weighted(blocks, terms, n)
    kept = hits.join(candidates(hits, k, mean), "file", "left_semi")
    return _summed(kept, mean).orderBy(F.desc(F.round("score", 9)), "id").limit(k)
