"""Rollups over the index: statistics, layers, important files, instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import LAYERS, TOOL_LAYERS, layer, short_path
from ctxspark.operators.graph import out_degree


def stats(chunks: DataFrame, embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: chunks, files, embeddings, edges."""
    return (
        chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"))
        .join(embeddings.agg(F.count("*").alias("embeddings")))
        .join(edges.agg(F.count("*").alias("edges")))
    )


def by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def names_per_file(chunks: DataFrame, names: int = 5) -> DataFrame:
    """(file, names, more): the first names per short path, and how many follow. Only ranks are shuffled, no whole lists."""
    keyed = chunks.select(short_path("file").alias("file"), "name", "ord", "id")
    w = Window.partitionBy("file")
    first = keyed.withColumn("rn", F.row_number().over(w.orderBy("ord", "id"))).where(F.col("rn") <= names)
    listed = first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rn", "name"))).alias("l"))
    total = keyed.groupBy(F.col("file").alias("f")).agg(F.count("*").alias("n"))
    return listed.join(total, F.col("file") == F.col("f")).select(
        "file", F.array_join(F.col("l.name"), ", ").alias("names"), F.greatest(F.col("n") - names, F.lit(0)).cast("long").alias("more"), F.col("n").alias("total")
    )


def layers(chunks: DataFrame, rules=LAYERS, files: int = 8) -> DataFrame:
    """(layer, files, listed): distinct short paths per layer, and the first of them."""
    own = chunks.select(short_path("file").alias("file")).distinct().withColumn("layer", layer("file", rules))
    first = own.withColumn("rn", F.row_number().over(Window.partitionBy("layer").orderBy("file"))).where(F.col("rn") <= files)
    listed = first.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("listed"))
    count = own.groupBy(F.col("layer").alias("l")).agg(F.count("*").alias("files"))
    return listed.join(count, F.col("layer") == F.col("l")).select("layer", "files", "listed")


def tool_layers(chunks: DataFrame) -> DataFrame:
    return layers(chunks, TOOL_LAYERS)


def top_importers(edges: DataFrame, n: int = 5) -> DataFrame:
    return out_degree(edges).orderBy(F.desc("imports"), "file").limit(n)


def important_files(ranks: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """The best ranked files with their chunk counts."""
    best = ranks.orderBy(F.desc("rank"), "file").limit(n)
    counts = chunks.groupBy(F.col("file").alias("f")).agg(F.count("*").alias("n"))
    return best.join(counts, F.col("file") == F.col("f"), "left").select("file", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("chunks")).orderBy(F.desc("rank"), "file")


def instructions(chunks: DataFrame, files: int = 30, names: int = 8) -> DataFrame:
    """The files with most names, and their first names."""
    return names_per_file(chunks, names).orderBy(F.desc("total"), "file").limit(files)
