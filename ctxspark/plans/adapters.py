"""The driver's tables in the shape of the engine's tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import human_name, tokenize
from ctxspark.session import spread

NOW = "2024-02-01 00:00:00"
QUERY = "ontion heea onTion ander"
FILE = "src/src1/en.ts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_of(prefix: str = ""):
    return F.concat(F.lit("src/"), F.col(f"{prefix}source"), F.lit("/"), F.col(f"{prefix}lang"), F.lit(".ts"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    first = F.substring_index("text", "\n", 1)
    named = docs.select(
        file_of().alias("file"), F.regexp_extract("text", r"^[^ \n]+", 0).alias("name"), F.col("doc_id").alias("ord"), "lang", "text",
        F.when(F.length(first) > 150, F.concat(F.substring(first, 1, 150), F.lit("..."))).otherwise(first).alias("signature"),
    )
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class").when(F.col("lang") == "de", "method").otherwise("interface")
    return named.select(
        F.concat("file", F.lit("#"), "ord").alias("id"), "file", kind.alias("type"), "name", "signature", F.col("text").alias("code"),
        F.md5("text").alias("hash"), F.concat_ws(" ", F.concat("lang", F.lit(".ts")), human_name("name"), "signature").alias("summary"), "ord",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of chunks, by the chunk's document."""
    own = chunks(spark, sf_dir).select("id", "ord")
    return table(spark, sf_dir, "embeddings").join(own, F.col("vec_id") == F.col("ord")).select(F.col("id").alias("chunk_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's file depends on that of document (7 d + 3) mod N."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    left = docs.select(file_of().alias("source_file"), F.pmod(F.col("doc_id") * 7 + 3, F.lit(n)).alias("to"))
    right = docs.select(F.col("doc_id"), file_of().alias("target_file"))
    return left.join(right, F.col("to") == F.col("doc_id")).where("source_file <> target_file").select("source_file", "target_file").distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(file_of().alias("file")).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, newest first, as commits to the file of document (event_id mod N)."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    events = table(spark, sf_dir, "events").where("event_type <> 'error'").select(
        F.col("ts"), F.pmod("event_id", F.lit(n)).alias("d"), "event_id"
    )
    # newest first: an order that needs no ranking of all events
    order = (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("commit_ord")
    return events.join(docs.select("doc_id", file_of().alias("path")), F.col("d") == F.col("doc_id")).select("path", "ts", order)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tracked: labelled documents, mtime their length, one more if toxic. Current: documents that are not German, mtime their length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = F.col("doc_id").cast("string").alias("path")
    old = docs.join(labels.select("doc_id", "toxic"), "doc_id").select(path, (F.col("n_chars") + F.col("toxic")).cast("double").alias("mtime"))
    return old, docs.where("lang <> 'de'").select(path, F.col("n_chars").cast("double").alias("mtime"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), tokenize("text").alias("tokens"))


def first_per_file(found: DataFrame) -> DataFrame:
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).where("rn = 1").drop("rn")
