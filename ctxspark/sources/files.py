"""Source files as a DataFrame."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.sources import ignore as ignoring

# What is scanned, and what is ignored whatever the user says.
INCLUDE = ["src/**/*.ts", "src/**/*.js"]
IGNORE = ["node_modules/**", "dist/**"]
ALWAYS_IGNORE = ["**/node_modules/**", "**/dist/**", "**/.git/**", "**/.ctxspark/**"]
SUFFIXES = (".ts", ".js")


def glob_regex(pattern: str) -> str:
    """A glob over relative paths as a regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """Globs of a .gitignore: a name matches at any depth, and what is below it. Negations are not supported."""
    found = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "!")):
            continue
        inner = line.strip("/")
        base = inner if "/" in inner or line.startswith("/") else f"**/{inner}"
        found += [base, f"{base}/**"] if not line.endswith("/") else [f"{base}/**"]
    return found


def wanted(path: str, include: list[str] | None = None, ignore: list[str] | None = None, gitignore: str = ""):
    """Condition on a column of relative paths."""
    column = F.col(path)
    keep = F.lit(False)
    for pattern in dict.fromkeys(include or INCLUDE):
        keep = keep | column.rlike(glob_regex(pattern))
    for pattern in dict.fromkeys([*ALWAYS_IGNORE, *(IGNORE if ignore is None else ignore), *ignore_patterns(gitignore)]):
        keep = keep & ~column.rlike(glob_regex(pattern))
    return keep & (column.endswith(SUFFIXES[0]) | column.endswith(SUFFIXES[1]))


def _listed(spark: SparkSession, root: str, include: list[str] | None, ignore: list[str] | None) -> DataFrame:
    """The wanted files of root, as binaryFile has them; contents are read only if they are asked for."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,js}").load(root)
    cut = len(root) + 1 if "://" in root else len(os.path.abspath(root)) + 1
    plain = F.regexp_replace("path", r"^file:/+", "/")
    named = files.withColumn("path", plain).withColumn("relative", F.col("path").substr(F.lit(cut + 1), F.length("path")))
    kept = named.where(wanted("relative", include, ignore))
    # the listing is with the driver already; as one string it comes in one call
    names = json.loads(spark.sparkContext._jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(files._jdf.inputFiles()))
    rules = ignoring.read_rules(spark, root, [_relative(x, cut) for x in names])
    if not rules:
        return kept
    # paths alone go through the rules
    gone = ignoring.ignored(kept.select("relative"), spark.createDataFrame(rules, ignoring.RULES))
    return kept.join(gone, "relative", "left_anti")


def _relative(uri: str, cut: int) -> str:
    """A listed file's path below the root."""
    return unquote(re.sub(r"^file:/+", "/", uri))[cut:]


def _text(content: str = "content"):
    """Bytes that are no UTF-8 count as U+FFFD."""
    return F.make_valid_utf8(F.col(content).cast("string")).alias("code")


def listing(spark: SparkSession, root: str, include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, mtime) of the wanted files under root; no content is read."""
    return _listed(spark, root, include, ignore).select("path", F.col("modificationTime").alias("mtime"))


def scan(spark: SparkSession, root: str, include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, mtime, code) of the wanted files under root. Empty files are left out."""
    return _listed(spark, root, include, ignore).select("path", F.col("modificationTime").alias("mtime"), _text())


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, code) of these files alone; names such as `[id].ts` aren't patterns."""
    files = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths])
    return files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("modificationTime").alias("mtime"), _text())
