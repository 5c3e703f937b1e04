"""Context for a task: graph neighbours first, then search results, packed into a budget; and the same for changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.paths import ending_pairs, normalised
from ctxspark.functions.text import estimate_tokens, first_filled, quarter_tokens, short_path
from ctxspark.operators import budget as packing
from ctxspark.operators.graph import neighbours

CLI_NEIGHBOURS, TOOL_NEIGHBOURS = 15, 10
ARCHITECTURE_SHARE = 0.4
AUTO_SHARES = (0.3, 0.5)
AUTO_OWN, AUTO_DEPENDENCIES = 8, 5
DIFF_DEPENDENCIES, DIFF_RELATED = 20, 10
ENTRY = ("section", "position", "id", "file", "name", "signature", "score")


def _line(indent: str = "", end: str = ""):
    return F.concat(F.lit(indent), short_path("file"), F.lit(": "), first_filled("signature", "name"), F.lit(end))


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def neighbour_chunks(chunks: DataFrame, edges: DataFrame, file: str, include_self: bool = True) -> DataFrame:
    """Chunks of the files next to `file`."""
    near = neighbours(edges, file)
    if not include_self:
        near = near.where(F.col("file") != file)
    return chunks.join(near, "file", "left_semi")


def _first(chunks: DataFrame, n: int, section: str) -> DataFrame:
    """The first n in index order."""
    top = chunks.orderBy("file", "ord", "id").limit(n)
    return top.select(
        F.lit(section).alias("section"), F.row_number().over(Window.orderBy("file", "ord", "id")).alias("position"),
        "id", "file", "name", "signature", F.lit(None).cast("double").alias("score"),
    )


def entries(chunks: DataFrame, edges: DataFrame, found: DataFrame, file: str | None, limit: int = CLI_NEIGHBOURS) -> DataFrame:
    """Neighbour chunks, then search results that are not among those shown."""
    near = _first(neighbour_chunks(chunks, edges, file) if file else chunks.limit(0), limit, "graph")
    rest = _ranked(found).join(near.select("id"), "id", "left_anti")
    return near.unionByName(rest.select(F.lit("search").alias("section"), "position", "id", "file", "name", "signature", "score"))


def pack_cli(listed: DataFrame, budget: int) -> DataFrame:
    """The command line's packing, by its own estimate of signatures."""
    costed = listed.withColumn("cost", quarter_tokens("signature"))
    return packing.prefix(costed, "cost", budget, ["section", "position"])


def pack_search(found: DataFrame, budget: int) -> DataFrame:
    lines = _ranked(found).withColumn("line", _line())
    return packing.prefix(lines.withColumn("cost", estimate_tokens("line")), "cost", budget, ["position"]).select("position", "id", "line", "cost", "used")


def _phase(rows: DataFrame, section: str, line, budget: float, spent) -> DataFrame:
    costed = rows.withColumn("line", line).withColumn("cost", estimate_tokens("line"))
    if spent is not None:
        costed = costed.join(F.broadcast(spent))  # one row
        costed = packing.prefix(costed, "cost", budget, ["position"], F.col("spent"))
    else:
        costed = packing.prefix(costed, "cost", budget, ["position"])
    return costed.select(F.lit(section).alias("section"), "position", "id", "line", "cost", F.col("used").cast("long").alias("used"))


def _spent(*packed: DataFrame) -> DataFrame:
    both = packed[0]
    for more in packed[1:]:
        both = both.union(more)
    return both.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("spent"))


def pack_tool(chunks: DataFrame, edges: DataFrame, found: DataFrame, file: str | None, budget: int) -> DataFrame:
    """Two phases: neighbours within 40 % of the budget, then search results that are no neighbours, the total going on."""
    all_near = neighbour_chunks(chunks, edges, file) if file else chunks.limit(0)
    near = _phase(_first(all_near, TOOL_NEIGHBOURS, ""), "architecture", _line("  ", "\n"), ARCHITECTURE_SHARE * budget, None)
    rest = _ranked(found).join(all_near.select("id"), "id", "left_anti")
    return near.union(_phase(rest, "related", _line("  ", "\n"), budget, _spent(near)))


def pack_auto(chunks: DataFrame, edges: DataFrame, found: DataFrame, file: str, budget: int = packing.AUTO_BUDGET) -> DataFrame:
    """Three phases: the file's own chunks, chunks of the files next to it, search results in neither."""
    own_line = F.concat(F.lit("  "), F.col("name"), F.lit(": "), first_filled("signature", "name"), F.lit("\n"))
    mine = chunks.where(F.col("file") == file)
    near = neighbour_chunks(chunks, edges, file, include_self=False)
    first, second = AUTO_SHARES
    own = _phase(_first(mine, AUTO_OWN, ""), "current", own_line, first * budget, None)
    next_to = _phase(_first(near, AUTO_DEPENDENCIES, ""), "dependencies", _line("  ", "\n"), second * budget, _spent(own))
    rest = _ranked(found).join(mine.select("id").union(near.select("id")), "id", "left_anti")
    return own.union(next_to).union(_phase(rest, "related", _line("  ", "\n"), budget, _spent(own, next_to)))


def changed_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of changed files; paths match if one ends with the other. Only distinct files are compared, with changed (path) by equal keys."""
    files = chunks.select("file").distinct().withColumn("norm", normalised(F.col("file")))
    paths = changed.select(normalised(F.col("path")).alias("changed_path")).distinct()
    hit = ending_pairs(files, "norm", paths, "changed_path").select("file").union(ending_pairs(paths, "changed_path", files, "norm").select("file"))
    return chunks.join(hit.distinct(), "file", "left_semi")


def diff_dependencies(chunks: DataFrame, edges: DataFrame, changed: DataFrame, limit: int = DIFF_DEPENDENCIES) -> DataFrame:
    """First chunks of unchanged files next to the changed ones."""
    touched = changed_chunks(chunks, changed).select("file").distinct()
    out = edges.join(touched, edges.source_file == touched.file).select(F.col("target_file").alias("file"))
    into = edges.join(touched, edges.target_file == touched.file).select(F.col("source_file").alias("file"))
    near = out.union(into).distinct().join(touched, "file", "left_anti")
    return chunks.join(near, "file", "left_semi").orderBy("file", "ord", "id").limit(limit)


def diff_related(chunks: DataFrame, edges: DataFrame, changed: DataFrame, found: DataFrame) -> DataFrame:
    """Top search results that are neither changed nor shown as dependencies."""
    seen = changed_chunks(chunks, changed).select("id").union(diff_dependencies(chunks, edges, changed).select("id"))
    return found.orderBy(F.desc("score"), "id").limit(DIFF_RELATED).join(seen, "id", "left_anti")
