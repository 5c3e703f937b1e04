"""Commit log and diff of a repository as DataFrames. A log is short (200 commits); git runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ctxspark.operators.recency import parse_log

COMMITS, SECONDS = 200, 5


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=SECONDS, check=True).stdout


def log(spark: SparkSession, root: str, commits: int = COMMITS) -> DataFrame:
    """(commit_ord, ts, path); empty where there is no repository."""
    try:
        text = _git(root, "log", "--format=%at %H", "--name-only", "--diff-filter=ACMR", "-n", str(commits))
    except (OSError, subprocess.SubprocessError):
        text = ""
    return parse_log(spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string"))


def changed(spark: SparkSession, root: str, base: str = "main") -> DataFrame:
    """(path) of sources that differ from base, or from the last commit where base isn't known."""
    if base.startswith("-"):
        raise ValueError("base is a branch or commit, not an option")
    try:
        text = _git(root, "diff", "--name-only", f"{base}...HEAD", "--")
    except (OSError, subprocess.SubprocessError):
        try:
            text = _git(root, "diff", "--name-only")
        except (OSError, subprocess.SubprocessError):
            text = ""
    return spark.createDataFrame([(x,) for x in text.splitlines() if x.endswith((".ts", ".js"))], "path string")
