"""Compact signatures of chunks, by kind, as Columns: lines of code as an array, searched and cut where the kind says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxspark.functions.text import SPACE

# Lengths, and what the lines of interest look like.
SHORT_INTERFACE, CONSTANT_LENGTH, FUNCTION_LINES = 200, 150, 10
COMMENT = ("*", "/**", "//", "/*")
CLASS_LINE = r"^\s*(?:export\s+)?class\s"
METHOD_LINE = r"^\s+(?:async\s+)?(\w+)\s*\("
TYPE_LINE = r"^\s*(?:export\s+)?(?:interface|type)\s"
MEMBER_LINE = r"^\s+(\w+)\s*[?]?\s*:"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(code: Column) -> Column:
    return F.split(code, "\n")


def _before_brace(text: Column) -> Column:
    return _trim(F.substring_index(text, "{", 1))


def _or(text: Column, other: Column) -> Column:
    return F.when(text != "", text).otherwise(other)


def _after_comments(code: Column) -> Column:
    """Trimmed lines from the first that is neither empty nor a comment."""

    def says_something(line: Column) -> Column:
        found = line != ""
        for mark in COMMENT:
            found = found & ~line.startswith(mark)
        return found

    def cut(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, says_something), True)
        return F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))

    return _once(F.transform(_lines(code), _trim), cut)


def _names(lines: Column, pattern: str) -> Column:
    return F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1))


def _listed(head: Column, names: Column) -> Column:
    """A declaration and its members' names, if it has any."""
    return F.concat(_before_brace(head), F.when(F.size(names) > 0, F.concat(F.lit(" { "), F.array_join(names, ", "), F.lit(" }"))).otherwise(""))


def of_function(code: Column, name: Column) -> Column:
    """Up to the first brace or arrow, over ten lines at most. The first brace may well belong to a parameter."""

    def cut(lines: Column) -> Column:
        end = F.array_position(F.transform(lines, lambda x: x.contains("{") | x.contains("=>")), True)
        head = F.array_join(F.slice(lines, F.lit(1), end.cast("int")), " ")
        arrow = F.concat(F.regexp_replace(F.substring_index(head, "=>", 1), f"{SPACE}+$", ""), F.lit(" =>"))
        ended = F.when(F.element_at(lines, F.greatest(end, F.lit(1)).cast("int")).contains("{"), _or(_before_brace(head), name)).otherwise(_trim(arrow))
        return F.when(F.size(lines) == 0, name).when(end > 0, ended).otherwise(_or(F.array_join(lines, " "), name))

    return _once(F.slice(_after_comments(code), 1, FUNCTION_LINES), cut)


def of_class(code: Column, name: Column) -> Column:
    """The class line, and all names that look like a method's at the beginning of a line."""

    def cut(lines: Column) -> Column:
        head = F.get(F.filter(lines, lambda x: x.rlike(CLASS_LINE)), F.lit(0))
        methods = F.filter(_names(lines, METHOD_LINE), lambda n: n != "constructor")
        return F.when(head.isNull(), F.concat(F.lit("class "), name)).otherwise(_listed(head, methods))

    return _once(_lines(code), cut)


def of_interface(code: Column, name: Column) -> Column:
    """Short ones whole, long ones as a list of members."""

    def cut(lines: Column) -> Column:
        head = F.get(F.filter(lines, lambda x: x.rlike(TYPE_LINE)), F.lit(0))
        whole = _trim(code)
        long = _listed(head, _names(lines, MEMBER_LINE))
        return F.when(head.isNull(), F.concat(F.lit("interface "), name)).when(F.length(whole) <= SHORT_INTERFACE, whole).otherwise(long)

    return _once(_lines(code), cut)


def of_constant(code: Column, name: Column) -> Column:
    line = F.coalesce(F.get(_after_comments(code), F.lit(0)), F.concat(F.lit("const "), name))
    return _once(line, lambda x: F.when(F.length(x) <= CONSTANT_LENGTH, x).otherwise(F.concat(F.substring(x, 1, CONSTANT_LENGTH), F.lit("..."))))


KINDS = {
    of_function: ("function", "method", "arrow-function"), of_class: ("class",), of_interface: ("interface", "type-alias"), of_constant: ("constant",),
}


def signature(kind: str | Column, code: str | Column, name: str | Column) -> Column:
    """Signature of a chunk; of a kind that isn't known, its first line. Null code has none; a null name is empty."""
    kind, code, name = [F.col(x) if isinstance(x, str) else x for x in (kind, code, name)]
    name = F.coalesce(name, F.lit(""))
    out = None
    for make, kinds in KINDS.items():
        out = (F if out is None else out).when(kind.isin(*kinds), make(code, name))
    return F.when(code.isNotNull(), out.otherwise(_trim(F.substring_index(code, "\n", 1))))
