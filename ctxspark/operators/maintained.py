"""The dependency graph and its PageRank, kept up to date by what changed.

**Edges.** Every relative specifier is stored with the path that it means before an extension is tried (`base`), whether a file fits or not. A
file's edges can only change if the file did, or if a path came or went that one of its specifiers could mean. `touched` finds those
by an equal key: a path is turned into the bases that would reach it. Nothing else is resolved again, and no other source is read.

**Ranks.** After k of the fixed number of steps a file's rank is s_k / n, where

    s_0 = 1,    s_k(v) = (1 - d) + d * sum over links u -> v of s_(k-1)(u) / out(u)

doesn't depend on n. So s_0 to s_20 are stored for each file, and a file that comes or goes elsewhere changes nothing. After a change only files
that can be reached from the targets of changed sources have other values; for them, and them alone, the steps are taken again, with
what others give them read from their stored steps. The values are those of steps taken anew over the whole graph.

A step is one shuffle: a row has a file's links and steps, and sends itself and a share for each link. Shares are summed before they
are shuffled, so a file that a third of all files import is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.paths import directory, resolved
from ctxspark.operators.graph import CANDIDATES, DAMPING, ITERATIONS, import_specifiers
from ctxspark.session import ensure_checkpoint_dir


# --- edges


def specifiers(sources: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(file, specifier, base) of relative imports."""
    found = import_specifiers(sources, path, code).where(F.col("specifier").startswith("."))
    return found.select(F.col("path").alias("file"), "specifier", resolved(directory(F.col("path")), F.col("specifier")).alias("base"))


def touched(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """Files with a specifier that could mean one of `paths` (path)."""
    bases = F.filter(
        F.array(*[F.when(F.col("path").endswith(c), F.expr(f"left(path, length(path) - {len(c)})")) for c in CANDIDATES]), lambda x: x.isNotNull()
    )
    keys = paths.select(F.explode(bases).alias("base")).distinct()
    return stored.join(keys, "base", "left_semi").select("file").distinct()


def resolve(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, target_file), each once: the first candidate among `paths` (path) that fits."""
    tried = stored.select("file", "base", F.posexplode(F.array(*[F.concat("base", F.lit(c)) for c in CANDIDATES])).alias("priority", "candidate"))
    hit = tried.join(paths.select(F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("file", "base").agg(F.min_by("candidate", "priority").alias("target_file")).select("file", "target_file").distinct()


# --- ranks


def _links(edges: DataFrame) -> DataFrame:
    """(file, targets): distinct targets of each source."""
    return edges.groupBy(F.col("source_file").alias("file")).agg(F.sort_array(F.collect_set("target_file")).alias("targets"))


def _constant(damping: float, iterations: int) -> Column:
    """Steps of a file that nothing links to."""
    return F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(1 - damping), iterations))


def _stepped(state: DataFrame, damping: float, iterations: int) -> DataFrame:
    """(file, steps) from (file, targets, degree, given, steps): targets that take part, the whole out-degree, what others give at each step, and [1.0]."""
    empty = F.lit(None)
    for step in range(1, iterations + 1):
        own = F.struct(F.col("file").alias("to"), F.lit(None).cast("double").alias("share"), "targets", "degree", "given", "steps")
        share = F.element_at("steps", -1) / F.col("degree")
        sent = F.transform(
            "targets",
            lambda t: F.struct(
                t.alias("to"), share.alias("share"), empty.cast("array<string>").alias("targets"), empty.cast("long").alias("degree"),
                empty.cast("array<double>").alias("given"), empty.cast("array<double>").alias("steps"),
            ),
        )
        rows = state.select(F.explode(F.concat(F.array(own), sent)).alias("m")).select("m.*")
        rest = {c: F.first(c, ignorenulls=True).alias(c) for c in ("targets", "degree", "given", "steps")}
        summed = rows.groupBy(F.col("to").alias("file")).agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("got"), *rest.values())
        new = (1 - damping) + damping * (F.col("got") + F.get("given", F.lit(step - 1)))
        state = summed.select("file", "targets", "degree", "given", F.array_append("steps", new).alias("steps"))
        if step % 10 == 0 and step < iterations:
            state = state.checkpoint()
    return state.select("file", "steps")


def steps(edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(file, steps) of all files with an edge, from (source_file, target_file)."""
    ensure_checkpoint_dir(edges.sparkSession)
    links = _links(edges)
    nodes = edges.select(F.explode(F.array("source_file", "target_file")).alias("file")).distinct()
    none = F.array().cast("array<string>")
    state = nodes.join(links, "file", "left").select(
        "file", F.coalesce("targets", none).alias("targets"), F.size(F.coalesce("targets", none)).cast("long").alias("degree"),
        F.array_repeat(F.lit(0.0), iterations).alias("given"), F.array(F.lit(1.0)).alias("steps"),
    )
    return _stepped(state, damping, iterations)


def reachable(edges: DataFrame, start: DataFrame, rounds: int, at_most: float) -> DataFrame | None:
    """Files (file) within so many links of `start`; None if they are more than at_most."""
    seen = start.select("file").distinct().checkpoint()
    frontier, n = seen, seen.count()
    for _ in range(rounds):
        if n > at_most:
            return None
        after = edges.join(frontier.withColumnRenamed("file", "source_file"), "source_file", "left_semi")
        frontier = after.select(F.col("target_file").alias("file")).distinct().join(seen, "file", "left_anti").checkpoint()
        more = frontier.count()
        if not more:
            return seen
        seen, n = seen.union(frontier).checkpoint(), n + more
    return seen


def updated_steps(stored: DataFrame, old: DataFrame, new: DataFrame, changed: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """steps(new) from the stored steps of `old`. changed: sources (file) whose edges differ."""
    ensure_checkpoint_dir(new.sparkSession)
    of = lambda edges: edges.join(changed.withColumnRenamed("file", "source_file"), "source_file", "left_semi").select(F.col("target_file").alias("file"))
    affected = reachable(new, of(old).union(of(new)), iterations - 1, stored.count() / 2)
    if affected is None:
        return steps(new, damping, iterations)
    nodes = new.select(F.explode(F.array("source_file", "target_file")).alias("file")).distinct()
    links = _links(new).withColumn("degree", F.size("targets").cast("long"))
    outside = nodes.join(affected, "file", "left_anti").join(stored, "file", "left").select("file", F.coalesce("steps", _constant(damping, iterations)).alias("steps"))
    # what files outside give, step by step
    into = affected.withColumnRenamed("file", "target_file")
    given = (
        new.distinct().join(into, "target_file", "left_semi")
        .join(outside.withColumnRenamed("file", "source_file"), "source_file")
        .join(links.select(F.col("file").alias("source_file"), "degree"), "source_file")
        .select("target_file", F.posexplode(F.transform("steps", lambda s: s / F.col("degree"))).alias("step", "share"))
        .groupBy("target_file", "step").agg(F.sum("share").alias("share"))
        .groupBy(F.col("target_file").alias("file")).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "share"))), lambda x: x["share"]).alias("given"))
    )
    inner = new.join(into, "target_file", "left_semi").groupBy(F.col("source_file").alias("file")).agg(F.collect_set("target_file").alias("inner"))
    none = F.array().cast("array<string>")
    state = (
        affected.join(nodes, "file", "left_semi").join(links, "file", "left").join(inner, "file", "left").join(given, "file", "left")
        .select(
            "file", F.coalesce("inner", none).alias("targets"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
            F.coalesce("given", F.array_repeat(F.lit(0.0), iterations)).alias("given"), F.array(F.lit(1.0)).alias("steps"),
        )
    )
    return _stepped(state, damping, iterations).unionByName(outside)


def ranks(stored: DataFrame) -> DataFrame:
    """(file, rank) after all steps."""
    n = F.broadcast(stored.agg(F.count("*").alias("n")))  # one row
    return stored.join(n).select("file", (F.element_at("steps", -1) / F.col("n")).alias("rank"))
