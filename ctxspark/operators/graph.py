"""The file dependency graph: PageRank, degrees, neighbours, import resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.paths import directory, resolved
from ctxspark.session import ensure_checkpoint_dir

DAMPING, ITERATIONS = 0.85, 20
#: Edges up to which one task may hold the whole graph (32 bytes each).
SMALL_EDGES = 1_000_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_file").alias("file")).union(edges.select(F.col("target_file").alias("file"))).distinct()


def _ranks_in_one_task(damping: float, iterations: int):
    def ranks(frames):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(frames) or [pd.DataFrame({"source_file": [], "target_file": []})])
        files = pd.Index(pd.unique(pd.concat([rows.source_file, rows.target_file]).dropna()))
        n = len(files)
        linked = rows.dropna()
        source, target = files.get_indexer(linked.source_file), files.get_indexer(linked.target_file)
        out = np.bincount(source, minlength=n)
        rank = np.full(n, 1.0 / max(n, 1))
        for _ in range(iterations):
            rank = (1 - damping) / n + damping * np.bincount(target, rank[source] / out[source], n) if n else rank
        yield pd.DataFrame({"file": files.astype(str), "rank": rank})

    return ranks


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(file, rank) after a fixed number of synchronous steps. What dangling files hold is not dealt out again.

    nodes: files without edges, to count as well. A graph whose checked size is small is ranked in one task; any other by joins, with
    its lineage cut every five steps.
    """
    edges = edges.select("source_file", "target_file").distinct()
    listed = edges if nodes is None else edges.union(nodes.select(F.col("file").alias("source_file"), F.lit(None).cast("string").alias("target_file")))
    if listed.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        return listed.coalesce(1).mapInPandas(_ranks_in_one_task(damping, iterations), "file string, rank double")
    return pagerank_by_joins(edges, nodes, damping, iterations)


def pagerank_by_joins(edges: DataFrame, nodes: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("source_file", "target_file").distinct()
    files = nodes_of(edges) if nodes is None else nodes_of(edges).union(nodes.select("file")).distinct()
    files = files.checkpoint()
    n = files.count()
    degree = edges.groupBy("source_file").agg(F.count("*").alias("out"))
    links = edges.join(degree, "source_file").checkpoint()
    rank = files.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    for step in range(1, iterations + 1):
        given = (
            links.join(rank, links.source_file == rank.file)
            .groupBy("target_file")
            .agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        )
        rank = files.join(given, files.file == given.target_file, "left").select(
            "file", (F.lit((1 - damping) / n) + damping * F.coalesce("given", F.lit(0.0))).alias("rank")
        )
        if step % 5 == 0:
            rank = rank.checkpoint()
    return rank


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("imports"))


def neighbours(edges: DataFrame, file: str, with_self: bool = True) -> DataFrame:
    """Files that `file` imports or is imported by."""
    out = edges.where(F.col("source_file") == file).select(F.col("target_file").alias("file"))
    into = edges.where(F.col("target_file") == file).select(F.col("source_file").alias("file"))
    found = out.union(into)
    if with_self:
        found = found.union(edges.sparkSession.createDataFrame([(file,)], "file string"))
    return found.distinct()


# What an import looks like.
IMPORT = r"""(?m)^\s*import\s+(?:[^'";]*?\sfrom\s+)?['"]([^'"]+)['"]"""
REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
# What is tried for a specifier, in this order.
CANDIDATES = ["", ".ts", ".js", "/index.ts", "/index.js"]


def import_specifiers(sources: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(path, specifier), each once: import declarations, and require() anywhere in the text."""
    found = F.array_distinct(F.array_union(F.regexp_extract_all(F.col(code), F.lit(IMPORT), 1), F.regexp_extract_all(F.col(code), F.lit(REQUIRE), 1)))
    return sources.select(F.col(path).alias("path"), F.explode(found).alias("specifier"))


def resolve_imports(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Relative specifiers (path, specifier) -> (source_file, specifier, target_file); null where no file fits."""
    relative = specifiers.where(F.col("specifier").startswith("."))
    base = resolved(directory(F.col("path")), F.col("specifier"))
    tried = relative.select(
        "path", "specifier", F.posexplode(F.array(*[F.concat(base, F.lit(c)) for c in CANDIDATES])).alias("priority", "candidate")
    )
    known = files.select(F.col("file").alias("known")).distinct()
    hit = tried.join(known, F.col("candidate") == F.col("known"), "left")
    best = F.min(F.when(F.col("known").isNotNull(), F.struct("priority", "known")))
    return hit.groupBy("path", "specifier").agg(best.alias("best")).select(
        F.col("path").alias("source_file"), "specifier", F.col("best.known").alias("target_file")
    )


def dependency_edges(sources: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(source_file, target_file), each once."""
    found = resolve_imports(import_specifiers(sources, path, code), sources.select(F.col(path).alias("file")))
    return found.where(F.col("target_file").isNotNull()).select("source_file", "target_file").distinct()
