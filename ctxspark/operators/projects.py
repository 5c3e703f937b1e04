"""What kind of project a listing shows: languages, frameworks, structure, tests and entry points, for a table of many projects at once.

The same rules as `sources.project` has for a folder on this machine, over rows (project, path) of listings, wherever they come from. Only names
that some rule knows are gathered, so a project of any size is a short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.sources.project import ENTRY_POINTS, EXTENSIONS, FRAMEWORKS, GLOBS, MARKERS, OTHER_TESTS, STRUCTURES, TESTS, WORKSPACES

_FOLDERS = sorted({f for some, more, *_ in STRUCTURES for f in [*some, *(more if more is not WORKSPACES else [])]})
_SUFFIXES = tuple(s for _, suffixes in MARKERS.values() for s in suffixes)
_FILES = sorted({f for files, _ in MARKERS.values() for f in files} | {f for files, _ in TESTS for f in files} | {*WORKSPACES, *ENTRY_POINTS})


def _some(names: str, wanted) -> Column:
    return F.arrays_overlap(F.col(names), F.array(*map(F.lit, sorted(wanted))))


def _chosen(pairs: list[tuple[Column, list[str]]]) -> Column:
    """The values of all conditions that hold, in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *[F.when(F.coalesce(c, F.lit(False)), F.array(*map(F.lit, v))).otherwise(none) for c, v in pairs]))


def profiles(listing: DataFrame, packages: DataFrame | None = None, project: str = "project", path: str = "path") -> DataFrame:
    """project, language, framework, structure, include, testPatterns, entryPoints. packages: project and text of a package.json.

    Languages come in the rules' order; without marker files, from the extensions of sources below src, in the rules' order as well.
    """
    name = F.col(path)
    top = ~name.contains("/")
    folder = F.lower(F.substring_index(name, "/", 1))
    end = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    rows = listing.select(
        F.col(project).alias("project"),
        F.when(name.isin(_FILES), name).alias("file"),
        F.when(top & _ends(name), end).alias("suffix"),
        F.when(~top & folder.isin(_FOLDERS), folder).alias("folder"),
        F.when(name.startswith("src/") & end.isin(*EXTENSIONS), end).alias("extension"),
    )
    seen = rows.groupBy("project").agg(*[F.collect_set(c).alias(f"{c}s") for c in ("file", "suffix", "folder", "extension")])
    if packages is None:
        seen = seen.withColumn("uses", F.array().cast("array<string>")).withColumn("main", F.lit(None).cast("string"))
    else:
        read = F.from_json("text", "main string, dependencies map<string,string>, devDependencies map<string,string>")
        keys = lambda c: F.map_keys(F.map_filter(F.coalesce(F.col(f"p.{c}"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), lambda _, v: v != ""))
        own = packages.select(F.col(project).alias("project"), read.alias("p")).select("project", "p.main", F.array_union(keys("dependencies"), keys("devDependencies")).alias("uses"))
        seen = seen.join(own, "project", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))
    marked = _chosen([(_some("files", files) | _some("suffixs", suffixes) if suffixes else _some("files", files), [x]) for x, (files, suffixes) in MARKERS.items()])
    found = _chosen([(_some("extensions", [e]), [x]) for e, x in EXTENSIONS.items()])
    structure = None
    for some, more, both, other in STRUCTURES:
        kind = F.when(_some("files" if more is WORKSPACES else "folders", more), both).otherwise(other)
        structure = (F if structure is None else structure).when(_some("folders", some), kind)
    known = seen.withColumn("language", F.when(F.size(marked) > 0, marked).otherwise(found))
    globs = _chosen([(_some("language", [x]), g) for x, g in GLOBS.items()])
    tests = _chosen([(_some("files", files), g) for files, g in TESTS])
    entries = _chosen([(_some("files", [f]), [f]) for f in ENTRY_POINTS])
    return known.select(
        "project", "language", _chosen([(_some("uses", [d]), [x]) for d, x in FRAMEWORKS.items()]).alias("framework"), structure.otherwise("flat").alias("structure"),
        F.when(F.size(globs) > 0, globs).otherwise(F.array(F.lit("**/*.ts"), F.lit("**/*.js"))).alias("include"),
        F.when(F.size(tests) > 0, tests).otherwise(F.array(*map(F.lit, OTHER_TESTS))).alias("testPatterns"),
        F.array_distinct(F.concat(F.filter(F.array(F.nullif("main", F.lit(""))), lambda x: x.isNotNull()), entries)).alias("entryPoints"),
    )


def _ends(name: Column) -> Column:
    hit = F.lit(False)
    for suffix in _SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit
