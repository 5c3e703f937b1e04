"""Commit recency: newest commit per file, decay, and the fuzzy match of files to committed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.paths import ending_pairs, normalised
from ctxspark.functions.text import short_path

DECAY_DAYS = 10.0


def decay(age_seconds: Column) -> Column:
    """exp(-days / 10); above 1 for the future."""
    return F.exp(-age_seconds / 86400.0 / DECAY_DAYS)


def latest_per_file(commits: DataFrame) -> DataFrame:
    """(path, ts, commit_ord): the first commit in log order that has the path; author times may be out of order."""
    return commits.groupBy("path").agg(F.min_by("ts", "commit_ord").alias("ts"), F.min("commit_ord").alias("commit_ord"))


def recency(commits: DataFrame, now: str) -> DataFrame:
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return latest_per_file(commits).select("path", "commit_ord", decay(age / 1e6).alias("recency"))


def match_files(files: DataFrame, recent: DataFrame) -> DataFrame:
    """(file, recency): the first path in log order that the file ends with, or that ends with the file's last two segments.

    Only distinct files are compared, by equal ends.
    """
    own = files.select("file").distinct().withColumn("norm", normalised(F.col("file"))).withColumn("last2", short_path("norm"))
    columns = ["file", "recency", "commit_ord"]
    joined = ending_pairs(own, "norm", recent, "path").select(columns).union(ending_pairs(recent, "path", own, "last2").select(columns))
    return joined.groupBy("file").agg(F.min_by("recency", "commit_ord").alias("recency"))


def parse_log(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(line_no, line) of `git log --format="%at %H" --name-only` -> (commit_ord, ts, path).

    by: columns that tell logs apart. One log is short (200 commits), so carrying the time forward in an ordered window is bounded.
    """
    from pyspark.sql import Window

    by = by or []
    order = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(r"^\d+\s+[a-f0-9]+$")
    carried = lines.select(*by, "line_no", F.trim("line").alias("line")).select(
        *by, "line", head.alias("head"),
        F.last(F.when(head, F.regexp_extract("line", r"^(\d+)", 1).cast("long")), ignorenulls=True).over(order).alias("at"),
        F.count_if(head).over(order).alias("commit_ord"),
    )
    return carried.where(~F.col("head") & (F.col("line") != "") & F.col("at").isNotNull()).select(
        *by, "commit_ord", F.timestamp_seconds("at").alias("ts"), F.col("line").alias("path")
    )
