"""Hybrid ranking: BM25, cosine, PageRank, recency and name matches in one score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.text import name_matches, tokenize
from ctxspark.operators import bm25 as bm
from ctxspark.operators.vector import cosine, literal_vector
from ctxspark.session import ensure_checkpoint_dir

FLOOR = 0.001


@dataclass(frozen=True)
class Weights:
    bm25: float = 0.30
    embedding: float = 0.40
    page_rank: float = 0.10
    name_boost: float = 0.10
    recency: float = 0.10


def corpus_text():
    """What is searched: name, signature, and the summary (which has both again)."""
    return F.concat_ws(" ", "name", "signature", "summary")


def scored(
    chunks: DataFrame, query: str, embeddings: DataFrame | None = None, query_vector=None, ranks: DataFrame | None = None,
    recent: DataFrame | None = None, weights: Weights = Weights(), terms: list[str] | None = None, lexical: DataFrame | None = None,
) -> DataFrame:
    """All chunks with their parts and score; no filter, no order.

    chunks: id, file, name, signature, summary (or tokens); embeddings: chunk_id, vector; ranks: file, rank; recent: file, recency;
    lexical: id, score (BM25 of the documents that have one), from stored postings; without it, texts are read.
    """
    if terms is None:
        terms = bm.query_tokens(chunks.sparkSession, query)
    if lexical is None:
        ensure_checkpoint_dir(chunks.sparkSession)
        own = chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", tokenize(corpus_text()))
        # tokens are made once: statistics, greatest score and result all come from what is left of them
        own = own.select("id", "file", "name", "signature", F.size("tokens").alias("dl"), *bm.frequencies(terms)).checkpoint()
        stats = bm.statistics_of_counts(own, terms)
        own = own.withColumn("bm25", bm.bm25_of_counts(terms, stats))
    else:
        own = chunks.join(lexical.select("id", "score"), "id", "left").withColumn("bm25", F.coalesce("score", F.lit(0.0)))
    top = F.broadcast((own if lexical is None else lexical.withColumnRenamed("score", "bm25")).agg(F.greatest(F.max("bm25"), F.lit(FLOOR)).alias("top")))  # one row
    parts = own.join(top).select("id", "file", "name", "signature", (F.col("bm25") / F.col("top")).alias("bm25"), name_matches("name", terms).alias("matches"))
    if embeddings is not None and query_vector is not None:
        similar = embeddings.select(F.col("chunk_id"), cosine(F.col("vector"), literal_vector(query_vector)).alias("cosine"))
        parts = parts.join(similar, F.col("id") == F.col("chunk_id"), "left").drop("chunk_id")
    else:
        parts = parts.withColumn("cosine", F.lit(None).cast("double"))
    if ranks is not None:
        most = F.broadcast(ranks.agg(F.greatest(F.max("rank"), F.lit(FLOOR)).alias("most")))  # one row
        shares = ranks.join(most).select(F.col("file").alias("ranked"), (F.col("rank") / F.col("most")).alias("page_rank"))
        parts = parts.join(shares, F.col("file") == F.col("ranked"), "left").drop("ranked")
    else:
        parts = parts.withColumn("page_rank", F.lit(None).cast("double"))
    if recent is not None:
        parts = parts.join(recent.select(F.col("file").alias("recent"), "recency"), F.col("file") == F.col("recent"), "left").drop("recent")
    else:
        parts = parts.withColumn("recency", F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (
        weights.bm25 * F.col("bm25") + weights.embedding * zero("cosine") + weights.page_rank * zero("page_rank")
        + weights.recency * zero("recency") + weights.name_boost * F.col("matches")
    )
    return parts.withColumn("score", score)


def search(chunks: DataFrame, query: str, k: int = 10, **signals) -> DataFrame:
    """The k best chunks with a positive score; equal scores by id."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be a whole number")
    return scored(chunks, query, **signals).where("score > 0").orderBy(F.desc("score"), "id").limit(k or 10)
