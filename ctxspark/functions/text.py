"""Text functions as Column expressions: tokens, names, paths, token estimates, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches ignore.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need "
    "to of in for on with at by from as into through during before after between out off over under again then once "
    "here there when where why how all each every both few more most other some no nor not only so than too very just "
    "because but and or if while that this it its which what who whom these those"
).split()

#: White space as JavaScript's \s has it.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"

# File layers by the first word that the path contains, in this order.
LAYERS = [
    (("controller",), "controllers"),
    (("service",), "services"),
    (("dal", "model", "repository"), "data access"),
    (("route",), "routes"),
    (("middleware", "validator", "validation"), "middleware"),
    (("util", "helper", "lib"), "utilities"),
    (("type", "interface"), "types"),
    (("config", "constant"), "config"),
    (("test", "spec"), "tests"),
]
# The shorter list of the assistant tools.
TOOL_LAYERS = [
    (("controller",), "controllers"),
    (("service",), "services"),
    (("dal", "model"), "data-access"),
    (("route",), "routes"),
    (("util", "helper"), "utilities"),
]


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_camel(text: str | Column, acronyms: bool = True) -> Column:
    out = F.regexp_replace(_column(text), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2") if acronyms else out


def tokenize(text: str | Column, stop_words=STOP_WORDS) -> Column:
    """Lower-case alphanumeric words of two characters or more, camel case split, stop words dropped."""
    # one space for a run of other characters, and a split at single ones, which needs no pattern
    words = F.split(F.regexp_replace(F.lower(split_camel(text)), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def human_name(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(split_camel(name), r"\.", " "))


def name_parts(name: str | Column) -> Column:
    return F.split(F.lower(F.regexp_replace(split_camel(name, acronyms=False), r"\.", " ")), f"{SPACE}+")


def name_matches(name: str | Column, query_tokens: list[str]) -> Column:
    """How many query tokens (repeats count) some part of the name contains."""
    parts = name_parts(name)

    def some(token: str) -> Column:
        return F.exists(parts, lambda p: p.contains(token)).cast("int")

    return sum(map(some, query_tokens), F.lit(0))


def estimate_tokens(text: str | Column) -> Column:
    """Model tokens by word lengths, and half a token for each line break."""
    text = _column(text)
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    cost = F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda n, w: n
        + F.when(F.length(w) <= 4, 1).when(F.length(w) <= 10, 2).when(F.length(w) <= 20, 3).otherwise(F.ceil(F.length(w) / 6)).cast("long"),
    )
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(cost + F.ceil(breaks * 0.5), F.lit(1))).cast("long")


def quarter_tokens(signature: str | Column) -> Column:
    """The command line's estimate: a quarter of the characters, and ten."""
    return (F.ceil(F.length(_column(signature)) / 4) + 10).cast("long")


def short_path(path: str | Column) -> Column:
    """The last two segments."""
    parts = F.split(_column(path), r"[/\\]")
    n = F.least(F.size(parts), F.lit(2))
    return F.array_join(F.slice(parts, -n, n), "/")


def first_filled(*columns: str | Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    *some, last = [_column(c) for c in columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in some], last)


def layer(path: str | Column, rules=LAYERS, other: str = "other") -> Column:
    low = F.lower(_column(path))
    out = None
    for words, name in rules:
        hit = None
        for word in words:
            hit = low.contains(word) if hit is None else hit | low.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def capitalised(text: str | Column) -> Column:
    """First character in upper case, the rest as it is."""
    text = _column(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def comment_words(code: str | Column) -> Column:
    """Text of the first doc comment, without its stars, tags and empty lines."""
    block = F.regexp_extract(_column(code), r"(?s)/\*\*(.*?)\*/", 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s?", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), " ")


def searchable_text(path: str | Column, name: str | Column, signature: str | Column, code: str | Column) -> Column:
    parts = F.array(base_name(path), human_name(name), _column(signature), comment_words(code))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")
