"""Top-level declarations of TypeScript and JavaScript sources, without a compiler.

A scanner walks a source once, stepping over strings, templates, comments and regular expressions, and cuts it into top-level
statements; their first words tell the kind. Extracted: functions, classes and their methods (no constructors, no accessors), variables
that hold arrow functions, other exported constants, interfaces, type aliases. A chunk's code has the comments before it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "([{", ")]}"
WORD = re.compile(r"[A-Za-z_$][\w$]*")
HEAD = re.compile(
    r"(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?P<kind>function\b\s*\*?|class\b|interface\b|enum\b|namespace\b|module\b|type\b|const\s+enum\b|const\b|let\b|var\b|import\b)?\s*(?P<name>[A-Za-z_$][\w$]*)?"
)
MODIFIERS = {"public", "private", "protected", "static", "override", "async", "abstract", "readonly", "declare"}
#: Characters after which a slash begins a regular expression, and a line doesn't end a statement.
BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^\n")
GOES_ON_AFTER = set(",=+-*/%&|?:<>(.[{!~^")
GOES_ON_WITH = set("=+-*/%&|?:<>,.)]};([`")
SCHEMA = "file string, ord int, id string, type string, name string, code string, hash string"


def skip(text: str, at: int) -> int:
    """End of the string, template, comment or regular expression that starts here; `at` itself if none does."""
    c = text[at]
    n = len(text)
    if c in "\"'":
        i = at + 1
        while i < n and text[i] != c and text[i] != "\n":
            i += 2 if text[i] == "\\" else 1
        return min(i + 1, n)
    if c == "`":
        i = at + 1
        while i < n and text[i] != "`":
            if text[i] == "\\":
                i += 2
            elif text.startswith("${", i):
                i = matching(text, i + 1) + 1
            else:
                i += 1
        return min(i + 1, n)
    if text.startswith("//", at):
        end = text.find("\n", at)
        return n if end < 0 else end
    if text.startswith("/*", at):
        end = text.find("*/", at + 2)
        return n if end < 0 else end + 2
    if c == "/":
        before = text[:at].rstrip(" \t")
        last = before[-1:] or "\n"
        if last in BEFORE_REGEX or re.search(r"\b(?:return|typeof|case|in|of)$", before[-8:]):
            i, inside = at + 1, False
            while i < n and text[i] != "\n" and (inside or text[i] != "/"):
                inside = text[i] == "[" or inside and text[i] != "]"
                i += 2 if text[i] == "\\" else 1
            if i < n and text[i] == "/":
                return i + 1
    return at


def matching(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at` (the end, if none does)."""
    depth, i, n = 0, at, len(text)
    while i < n:
        end = skip(text, i)
        if end > i:
            i = end
            continue
        if text[i] in OPEN:
            depth += 1
        elif text[i] in CLOSE:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return n - 1


def gap(text: str, at: int) -> int:
    """End of the white space and comments from here."""
    n = len(text)
    while at < n:
        if text[at].isspace():
            at += 1
        elif text.startswith(("//", "/*"), at):
            at = skip(text, at)
        else:
            break
    return at


def body_end(text: str, at: int) -> int:
    """After the first braces from here that are a body: not within brackets, not a type after a colon."""
    i, n, typed = at, len(text), False
    while i < n:
        end = skip(text, i)
        if end > i:
            i = end
            continue
        c = text[i]
        if c == ";":
            return i + 1
        if c == "{":
            close = matching(text, i)
            if not typed:
                return close + 1
            i, typed = close + 1, False
            continue
        if c in "([":
            i = matching(text, i)
        elif c == ":":
            typed = True
        elif not c.isspace() and c not in "|&":
            typed = False
        i += 1
    return n


def line_end(text: str, at: int) -> int:
    """After the semicolon, or the line break that can't be within the statement."""
    i, n, last = at, len(text), ""
    while i < n:
        end = skip(text, i)
        if end > i:
            if not text.startswith(("//", "/*"), i):
                last = '"'
            i = end
            continue
        c = text[i]
        if c == ";":
            return i + 1
        if c in OPEN:
            i = matching(text, i)
            last = ")"
        elif c == "\n":
            after = text[gap(text, i) : gap(text, i) + 1]
            if last and not (last in GOES_ON_AFTER and not text[:i].rstrip().endswith("=>") or text[:i].rstrip().endswith("=>") or after in GOES_ON_WITH):
                return i
        elif not c.isspace():
            last = c
        i += 1
    return n


def statements(text: str):
    """(start, first, end) of top-level statements: with and without leading comments."""
    at, n = 0, len(text)
    while at < n:
        first = gap(text, at)
        if first >= n:
            return
        head = HEAD.match(text, first)
        kind = re.sub(r"\s+", " ", (head["kind"] or "").rstrip(" *\n\t"))
        blocky = kind in {"function", "class", "interface", "enum", "const enum", "namespace", "module"}
        end = body_end(text, head.end() if blocky else first) if blocky else line_end(text, first)
        end = max(end, first + 1)
        yield at, first, end, head, kind
        at = end


def _declarations(text: str, at: int):
    """(name, is arrow function) of the variables of a statement that have an initialiser; text from after the keyword."""
    parts, i, begin = [], at, at
    while i < len(text):
        end = skip(text, i)
        if end > i:
            i = end
            continue
        if text[i] in OPEN:
            i = matching(text, i)
        elif text[i] in ",;":
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    parts.append(text[begin:])
    for part in parts:
        name = WORD.match(part.strip())
        if not name:
            continue
        value = _initialiser(part)
        if value is not None:
            yield name[0], _is_arrow(value)


def _initialiser(part: str) -> str | None:
    i = 0
    while i < len(part):
        end = skip(part, i)
        if end > i:
            i = end
            continue
        if part[i] in OPEN:
            i = matching(part, i)
        elif part[i] == "=" and part[i + 1 : i + 2] != ">":
            return part[i + 1 :].strip()
        elif part.startswith("=>", i):
            i += 1
        i += 1
    return None


def _is_arrow(value: str) -> bool:
    value = re.sub(r"^async\b\s*", "", value)
    if value.startswith("<"):
        value = value[value.find(">") + 1 :].lstrip()
    if value.startswith("("):
        rest = value[matching(value, 0) + 1 :].lstrip()
        return rest.startswith("=>") or rest.startswith(":") and "=>" in rest
    name = WORD.match(value)
    return bool(name) and value[name.end() :].lstrip().startswith("=>")


def _methods(text: str, first: int, end: int):
    """(name, code) of the methods of a class statement."""
    open_ = first
    while open_ < end and text[open_] != "{":
        step = skip(text, open_)
        open_ = step if step > open_ else open_ + 1
    at, stop = open_ + 1, matching(text, open_) if open_ < end else end
    while at < stop:
        begin = gap(text, at)
        if begin >= stop:
            return
        i, words = begin, []
        while i < stop:
            i = gap(text, i)
            if text[i] == "@":  # a decorator
                i = WORD.match(text, i + 1).end() if WORD.match(text, i + 1) else i + 1
                if text[i : i + 1] == "(":
                    i = matching(text, i) + 1
                continue
            word = re.compile(r"[#*]?\s*[A-Za-z_$#][\w$]*").match(text, i)
            if not word:
                break
            words.append(word[0].lstrip("*# "))
            i = word.end()
        i = gap(text, i)
        if text[i : i + 1] == "<":
            i = gap(text, text.find(">", i) + 1)
        callable_ = text[i : i + 1] in ("(", "?") and "(" in text[i : i + 2]
        name = words[-1] if words else ""
        accessor = len(words) > 1 and words[-2] in ("get", "set")
        if callable_:
            close = body_end(text, i)
            if name and name != "constructor" and not accessor and set(words[:-1]) <= MODIFIERS:
                yield name, text[at : min(close, stop)].strip()
            at = max(min(close, stop), begin + 1)
        else:
            at = max(min(line_end(text, i), stop), begin + 1)


def chunks_of(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA: functions, classes each with its methods, variables, interfaces, type aliases."""
    kinds: dict[str, list] = {"function": [], "class": [], "variable": [], "interface": [], "type-alias": []}
    for at, first, end, head, kind in statements(text):
        code = text[at:end].strip()
        name = head["name"] or "anonymous"
        if kind == "function":
            kinds["function"].append(("function", name, code))
        elif kind == "class":
            name = "anonymous" if name in ("extends", "implements") else name
            kinds["class"].append(("class", name, code))
            kinds["class"] += [("method", f"{name}.{m}", c) for m, c in _methods(text, first, end)]
        elif kind in ("const", "let", "var"):
            for variable, arrow in _declarations(text[first:end], head.start("name") - first if head["name"] else 0):
                if arrow:
                    kinds["variable"].append(("arrow-function", variable, code))
                elif head["export"]:
                    kinds["variable"].append(("constant", variable, code))
        elif kind == "interface":
            kinds["interface"].append(("interface", name, code))
        elif kind == "type" and head["name"]:
            kinds["type-alias"].append(("type-alias", name, code))
    rows = [x for group in kinds.values() for x in group]
    return [(path, i, f"{path}#{n}", k, n, c, hashlib.md5(c.encode()).hexdigest()) for i, (k, n, c) in enumerate(rows)]


#: Sources whose declarations a task holds at once, however many an Arrow batch has.
SLICE = 256


def _chunker(failures: bool, cut=chunks_of):
    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["error"] * failures
        for frame in (whole.iloc[at : at + SLICE] for whole in frames for at in range(0, len(whole), SLICE)):
            rows = []
            for path, code in zip(frame["path"], frame["code"]):
                if code is None:
                    continue
                try:
                    found = cut(path, code)
                except Exception as error:
                    if not failures:
                        raise
                    rows.append((path, -1, None, None, None, None, None, f"{type(error).__name__}: {error}"))
                else:
                    rows += [(*row, None) for row in found] if failures else found
            yield pd.DataFrame(rows, columns=names)

    return run


def extract(sources: DataFrame) -> DataFrame:
    """sources (path, code) -> all declarations in order of extraction (`ord`)."""
    return sources.select("path", "code").mapInPandas(_chunker(False), SCHEMA)


def extract_or_error(sources: DataFrame, cut=chunks_of) -> DataFrame:
    """The same with `error`; a file that can't be cut has one row, with its path and error alone, and the others go on.

    cut: another (path, text) -> rows of SCHEMA, for other languages.
    """
    return sources.select("path", "code").mapInPandas(_chunker(True, cut), SCHEMA + ", error string")


def last_wins(chunks: DataFrame) -> DataFrame:
    """One row per id: of declarations with one name in one file, the last."""
    order = Window.partitionBy("id").orderBy(F.desc("ord"))
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
