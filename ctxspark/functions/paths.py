"""Path arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def normalised(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.translate(path, "\\", "/")


def resolved(base: Column, relative: Column) -> Column:
    """`relative` from directory `base`: "." drops out, ".." goes up."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def ending_pairs(left: DataFrame, long: str, right: DataFrame, short: str) -> DataFrame:
    """Rows of left and right where the string `long` ends with `short`. Column names of the two sides must differ.

    A long one is cut to each length that short ones have, and these ends are joined by equality: a key holds true pairs alone, so paths with
    one last segment (`index.ts`) only meet those that end like them, parents included. The lengths are no more than the longest path has characters.
    """
    lengths = sorted(r[0] for r in right.select(F.length(short)).where(F.col(short).isNotNull()).distinct().collect())
    if not lengths:
        return left.join(right, F.lit(False))
    ends = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length(long) >= n, F.right(F.col(long), n)))
    keyed = left.withColumn("__end", F.explode(F.filter(ends, lambda x: x.isNotNull())))
    return keyed.join(right, F.col("__end") == F.col(short)).drop("__end")
