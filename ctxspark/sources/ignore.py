"""Ignore files as git has them, over a table of paths: nested files, negation, folders, the last match.

Rules are rows. Each belongs to the folder of its ignore file and holds for what is below it. A path is ignored if one of its folders is, or it is itself;
of the rules that match, the one in the deepest file decides, and within a file the last one. Nothing below an ignored folder is taken back.

Spark's readers leave out hidden files, so ignore files themselves, few and small, come through Hadoop's file systems; roots may be remote.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "dir string, depth int, place int, pattern string, negated boolean, folders boolean"


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over the path below the file's folder, negated, folders only) of a line; None for comments and empty lines."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored = "/" in line
    return ("^" if anchored else "^(?:.*/)?") + _regex(line.removeprefix("/")) + "$", negated, folders


def _regex(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        rest = glob[at:]
        start = at == 0 or glob[at - 1] == "/"
        if start and rest.startswith("**/"):
            out, at = out + "(?:.*/)?", at + 3
        elif start and rest == "**":
            out, at = out + ".+", at + 2
        elif rest[0] == "*":
            out, at = out + "[^/]*", at + (len(rest) - len(rest.lstrip("*")))
        elif rest[0] == "?":
            out, at = out + "[^/]", at + 1
        elif rest[0] == "[" and (found := re.match(r"\[(!|\^)?(\]?[^\]]*)\]", rest)):
            inner = re.sub(r"([\\\[&^])", r"\\\1", found[2]).replace("]", r"\]")
            out, at = out + f"(?!/)[{'^' if found[1] else ''}{inner}]", at + found.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, at = out + re.escape(rest[1]), at + 2
        else:
            out, at = out + re.escape(rest[0]), at + 1
    return out


def _rows(folder: str, text: str | None) -> list[tuple]:
    depth = folder.count("/") + 1 if folder else 0
    parsed = ((i, rule(line)) for i, line in enumerate((text or "").split("\n")))
    return [(folder, depth, i, *found) for i, found in parsed if found]


def rules(files: DataFrame) -> DataFrame:
    """RULES from ignore files (dir, text): dir relative to the root, without slashes at its ends; the root's is empty."""

    def parse(frames):
        import pandas as pd

        for frame in frames:
            rows = [row for folder, text in zip(frame["dir"], frame["text"]) for row in _rows(folder, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    return files.select("dir", "text").mapInPandas(parse, RULES)


def read_rules(spark: SparkSession, root: str, files: list[str], name: str = ".gitignore") -> list[tuple]:
    """Rows of RULES from the ignore files of all folders that `files` (relative to root) are in."""
    root, folders = root.rstrip("/"), {""}
    for file in files:
        while "/" in file and (file := file.rpartition("/")[0]) not in folders:
            folders.add(file)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    quoted = sorted(re.sub(r"([\\{}\[\]*?,^])", r"\\\1", f) for f in folders - {""})
    globs = [f"{root}/{name}", *(f"{root}/{{{','.join(quoted[at : at + 200])}}}/{name}" for at in range(0, len(quoted), 200))]
    out = []
    for glob in globs:
        for status in system.globStatus(path(glob)) or []:
            stream = system.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            folder = status.getPath().getParent().toUri().getPath().removeprefix(path(root).toUri().getPath()).strip("/")
            out += _rows(folder, text)
    return out


def ignored(paths: DataFrame, rules: DataFrame, path: str = "relative") -> DataFrame:
    """Distinct paths (path) that the rules ignore.

    Rules meet the folders and files below their own folder by an equal key, the folder. A path has as many keys as it is deep, squared.
    """
    parts = F.split(F.col(path), "/")
    # itself and its folders; each with the folders above it
    entries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("entry"), (n < F.size(parts)).alias("folder")))
    each = paths.select(F.col(path)).distinct().select(path, F.explode(entries).alias("e")).select(path, "e.entry", "e.folder")
    entry = each.select("entry", "folder").distinct()
    above = F.split("entry", "/")
    keyed = entry.select("entry", "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda n: F.array_join(F.slice(above, F.lit(1), n), "/"))).alias("dir"))
    met = keyed.join(rules, "dir").where(~F.col("folders") | F.col("folder"))
    below = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(dir) + 2)"))
    hit = met.where(F.regexp(below, F.col("pattern")))
    last = hit.groupBy("entry", "folder").agg(F.max_by("negated", F.struct("depth", "place")).alias("negated")).where("not negated")
    return each.join(last, ["entry", "folder"], "left_semi").select(path).distinct()
