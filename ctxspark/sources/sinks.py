"""Rendering of result lists as text, JSON or markdown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.text import first_filled, short_path


def lines(found: DataFrame) -> DataFrame:
    """One `line` per result: [score] name, short path, signature."""
    return found.select(
        "id", F.format_string("[%.4f] %s  %s  %s", F.col("score"), F.col("name"), short_path("file"), first_filled("signature", "name")).alias("line")
    )


def as_json(found: DataFrame) -> DataFrame:
    """One row: a JSON array of the results, which are a top-k list."""
    return found.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*"))), {"pretty": "true"}).alias("json"))


def as_markdown(listed: DataFrame, title: str) -> DataFrame:
    """One row: the entries of a context (section, position, ...) below headings."""
    item = F.concat(F.lit("- **"), short_path("file"), F.lit("**: `"), first_filled("signature", "name"), F.lit("`"))
    sections = listed.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))).alias("i"))
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join(F.col("i.item"), "\n"))
    return sections.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.sort_array(F.collect_list(block)), "\n\n")).alias("markdown"))


def write_json(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


# The texts that command-line users know. Each style: before, (section, heading, line of an entry) in order, after.
CONTEXT = {
    "text": ("", [("graph", "ARCH:\n", "  {file}: {signature}\n"), ("search", "\nCONTEXT:\n", "  {file}: {signature}\n")], "\nTASK:\n  {task}\n"),
    "markdown": (
        "# Context for: {task}\n\n**Target file:** `{target}`\n\n",
        [("graph", "## Architecture (dependencies)\n\n", "- `{file}`: `{signature}`\n"), ("search", "\n## Relevant code\n\n", "- **{name}** (`{file}`): `{signature}`\n")],
        "\n## Task\n\n{task}\n",
    ),
    "prompt": (
        "I'm working on the file `{target}` in a codebase. Here's the relevant context:\n\n",
        [("graph", "## Codebase Architecture\n\n", "{file}: {signature}\n"), ("search", "\n## Related Code\n\n", "{file}: {signature}\n")],
        "\n## Task\n\n{task}",
    ),
}
DIFF = {
    "text": ("", [("changed", "\nCHANGED:\n\n", "  {file}: {signature}\n"), ("dependencies", "\nDEPENDENCIES:\n\n", "  {file}: {signature}\n")], ""),
    "markdown": (
        "\n# PR Context: {task}\n\n",
        [
            ("changed", "## Changed files ({count} chunks)\n\n", "- `{file}`: `{signature}`\n"),
            ("dependencies", "\n## Dependencies ({count} chunks)\n\n", "- `{file}`: `{signature}`\n"),
            ("related", "\n## Related code\n\n", "- **{name}** (`{file}`): `{signature}`\n"),
        ],
        "",
    ),
}


def _filled(template: str, **columns):
    """A template with columns in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def render(listed: DataFrame, style: tuple, counts: dict[str, int] | None = None, **values: str) -> DataFrame:
    """One row, `text`: the entries of a context (section, position, file, name, signature) in a style of CONTEXT or DIFF.

    values: task and target. counts: how many a section has, if it shows only its first. Entries are result lists, not corpora.
    """
    before, sections, after = style
    given = {k: F.lit(v) for k, v in values.items()}
    signed = {"file": short_path("file"), "name": F.col("name"), "signature": first_filled("signature", "name")}
    parts = [_filled(before, **given)]
    for section, heading, line in sections:
        entry = F.when(F.col("section") == section, F.struct("position", _filled(line, **signed).alias("line")))
        found = F.collect_list(entry)
        count = F.lit(counts[section]) if counts and section in counts else F.size(found)
        parts += [_filled(heading, count=count, **given), F.array_join(F.transform(F.sort_array(found), lambda x: x["line"]), "")]
    return listed.agg(F.concat(*parts, _filled(after, **given)).alias("text"))


def context_json(listed: DataFrame, task: str, target: str | None) -> DataFrame:
    """One row: the same context as a JSON object."""
    entry = F.struct(short_path("file").alias("file"), "name", first_filled("signature", "name").alias("signature"), F.coalesce("score", F.lit(1.0)).alias("score"), F.col("section").alias("source"))
    found = F.transform(F.sort_array(F.collect_list(F.struct("section", "position", entry.alias("e")))), lambda x: x["e"])
    whole = F.struct(F.lit(task).alias("task"), F.lit(target).alias("file"), found.alias("entries"), F.size(found).alias("totalEntries"))
    return listed.agg(F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
