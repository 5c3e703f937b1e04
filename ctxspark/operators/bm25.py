"""BM25 over token arrays, without exploding them: one pass for the statistics, one for the scores."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.session import ensure_checkpoint_dir

K1, B = 1.2, 0.75


def query_tokens(spark, text: str) -> list[str]:
    """The query's tokens in order, repeats kept, by the same expression as the documents'."""
    from ctxspark.functions.text import tokenize

    return spark.createDataFrame([(text,)], "q string").select(tokenize("q").alias("t")).first()["t"]


def _tf(tokens: str, term: str) -> Column:
    return F.size(F.filter(F.col(tokens), lambda x: x == term))


def frequencies(terms: list[str], tokens: str = "tokens") -> list[Column]:
    """tf0, tf1, ... of the query's distinct terms: all that scoring needs of a text, besides its length."""
    return [_tf(tokens, t).alias(f"tf{i}") for i, t in enumerate(dict.fromkeys(terms))]


def statistics_of_counts(counted: DataFrame, terms: list[str], length: str = "dl") -> dict:
    """Number of documents, mean length (documents without tokens count) and each term's document frequency."""
    unique = list(dict.fromkeys(terms))
    row = counted.agg(
        F.count("*").alias("n"), F.sum(length).alias("length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(unique))]
    ).first()
    return {"n": row["n"], "mean": (row["length"] or 0) / (row["n"] or 1), "df": {t: row[f"df{i}"] for i, t in enumerate(unique)}}


def statistics(docs: DataFrame, terms: list[str], tokens: str = "tokens") -> dict:
    """The same from tokens."""
    return statistics_of_counts(docs.select(F.size(tokens).alias("dl"), *frequencies(terms, tokens)), terms)


def bm25_of_counts(terms: list[str], stats: dict, length: str | Column = "dl", counts: dict | None = None) -> Column:
    """Score of a document; a term that the query has twice counts twice. counts: a term's frequency, if not a column tf0, tf1, ..."""
    n, mean = stats["n"], stats["mean"] or 1.0
    length = (F.col(length) if isinstance(length, str) else length).cast("double")
    counts = counts or {t: F.col(f"tf{i}") for i, t in enumerate(dict.fromkeys(terms))}
    total: Column = F.lit(0.0)
    for term in terms:
        df = stats["df"][term]
        if not df:
            continue
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        tf = counts[term].cast("double")
        total = total + F.when(tf > 0, F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (length / mean)))).otherwise(0.0)
    return total


def bm25(terms: list[str], stats: dict, tokens: str = "tokens") -> Column:
    """The same from tokens."""
    return bm25_of_counts(terms, stats, F.size(tokens), {t: _tf(tokens, t) for t in terms})


def term_counts(tokens: str = "tokens") -> Column:
    """Array of (term, tf) of one document: its sorted tokens are cut where the term changes, so nothing is shuffled."""

    def counted(found: Column) -> Column:
        last = F.size(found)
        at = F.sequence(F.lit(1), last)
        starts = F.filter(at, lambda i: (i == 1) | (F.get(found, i - 1) != F.get(found, i - 2)))

        def between(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(last + 1))
            return F.zip_with(starts, ends, lambda i, j: F.struct(F.get(found, i - 1).alias("term"), (j - i).cast("long").alias("tf")))

        return F.get(F.transform(F.array(starts), between), 0)

    nothing = F.array().cast("array<struct<term:string,tf:bigint>>")
    # a transform over one element binds the sorted array, and the starts, once; sort_array compares without a lambda
    cut = F.get(F.transform(F.array(F.sort_array(tokens)), counted), 0)
    return F.when(F.size(tokens) > 0, cut).otherwise(nothing)


def postings(docs: DataFrame, doc_id: str = "id", tokens: str = "tokens", length: Column | None = None) -> DataFrame:
    """(term, id, tf, dl): the index form, for stores that are partitioned by term. One row of docs is one document. length: if tokens aren't all of it."""
    counted = docs.select(doc_id, (F.size(tokens) if length is None else length).alias("dl"), F.explode(term_counts(tokens)).alias("p"))
    return counted.select(F.col("p.term").alias("term"), doc_id, F.col("p.tf").alias("tf"), "dl")


def bm25_postings(posted: DataFrame, terms: list[str], n: int, mean: float, doc_id: str = "id") -> DataFrame:
    """The same scores from postings: only the query's terms are read."""
    times = {t: terms.count(t) for t in terms}
    # a query has a handful of terms
    asked = F.broadcast(posted.sparkSession.createDataFrame(list(times.items()), "term string, times int"))
    hits = posted.where(F.col("term").isin(*times)).join(asked, "term")
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("dl") / F.lit(mean))))
    return hits.join(df, "term").groupBy(doc_id).agg(F.sum(F.col("times") * idf * norm).alias("score"))


#: Rows up to which a table is sent to every task; beyond that Spark deals both sides of the join.
BROADCAST_ROWS = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """df for a broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def top_documents(docs: DataFrame, questions: DataFrame, k: int, doc_id: str = "id", question_id: str = "question", tokens: str = "tokens") -> DataFrame:
    """(question, id, score, rank): the k best documents of each of many questions; scores equal to nine places go by id.

    docs: one row per document, id and tokens; questions: one row each, question and tokens. Only postings of terms that some question has are kept. What
    is shuffled is one partial score per task, question and document, then k rows per task and question.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    asked = questions.select(F.col(question_id).alias("question"), F.explode(tokens).alias("term")).groupBy("question", "term").agg(F.count("*").alias("times"))
    asked = asked.checkpoint()
    terms = asked.select("term").distinct()
    docs = docs.select(doc_id, tokens).persist(StorageLevel.DISK_ONLY)  # texts are cut into tokens once
    try:
        row = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean")).first()
        n, mean = row["n"], row["mean"] or 1.0
        hits = postings(docs, doc_id, tokens).join(sent(terms), "term", "left_semi").checkpoint()
    finally:
        docs.unpersist()
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("dl") / F.lit(mean))))
    weighted = asked.join(sent(df.checkpoint()), "term").select("question", "term", (F.col("times") * idf).alias("weight"))
    scored = hits.join(sent(weighted), "term").groupBy("question", F.col(doc_id).alias("id")).agg(F.sum(F.col("weight") * norm).alias("score"))
    order = Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
