"""Embedding near-dedup: all pairs with a cosine of 0.95 or more, by randomised binary codes.

1. Equal vectors are merged; a merged vector carries how many it stands for.
2. Candidates: up to `MAX_CELLS` vectors with the smallest hashes serve as pivots. A vector is at home in the cell of its nearest pivot
   and visits all cells whose pivot is nearly as near (no cap on their number): by a cosine that is less by up to d * |p - q| / 2, with
   d the distance of unit vectors at the threshold and p, q the two pivots. If two linked vectors x, y at home in p, q both failed
   that, <x - y, p - q> would exceed d * |p - q|; so they always meet in a home of one of them. Cells are dealt in blocks of bounded size, the homes' times the visitors'.
3. A vector x is rotated at random and kept as signs b with the factor f = <x, b>. In a cell, homes q are compared with visitors'
   codes: <q, b> / f is an unbiased estimate of <q, x>. Its upper bound is the lesser of a six-sigma one and of what the triangle
   inequality of angles allows, which nothing can exceed. Only visitors with a pair whose bound reaches the threshold go on.
4. Those pairs are recomputed exactly, in double precision, block by block. A block sends sums of links per vector and a forest of links,
   never its pairs.

Defined results: null, zero, and non-finite vectors and those with null components link with nothing; vectors of different lengths
neither; repeated rows link with one another like other equal vectors; a null vec_id has its group's least id; an empty table gives
an empty result; other columns are ignored. A vector's identity is its XXH64: of n different vectors, two share one by a chance of n^2 / 2^65.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm import common

THRESHOLD = 0.95
MAX_CELLS = 4096
CELL_VECTORS = 256
#: For rounding.
SLACK = 1e-6
SIGMAS = 6.0
#: Homes and visitors of one block.
BLOCK_HOMES, BLOCK_VISITORS = 512, 2048


@lru_cache(maxsize=4)
def rotation(size: int):
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit):
    """Signs of the rotated unit vectors, packed, and their factors."""
    import numpy as np

    turned = unit.astype(np.float32) @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def upper_bounds(queries, codes, factors):
    """Upper bounds of <query, x> for unit queries and coded unit vectors x."""
    import numpy as np

    size = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    g = np.clip((queries.astype(np.float32) @ rotation(size)) @ signs.T, -1, 1)
    f = np.clip(factors.astype(np.float32), 1e-3, 1)
    rest = np.sqrt(1 - f * f)
    sure = np.where(g >= f, 1.0, g * f + np.sqrt(1 - g * g) * rest)
    likely = g / f + SIGMAS * rest / f / np.sqrt(max(size - 1, 1))
    return np.minimum(sure, likely) + 1e-4


def _vectors(column):
    """Of a list array: (row numbers, matrix) for every length that occurs."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def unit_of(x):
    import numpy as np

    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ASSIGNED = "size int, cell int, home int, node long, n long, vec binary, code binary, factor float, cells array<int>"


def margins(pivots, threshold: float):
    """By how much less a cosine each cell may have than the home cell, one row for each home."""
    import numpy as np

    found = np.empty((len(pivots), len(pivots)), np.float32)
    for at in range(0, len(pivots), 256):
        apart = np.sqrt(np.maximum(2 - 2 * pivots[at : at + 256] @ pivots.T, 0))
        found[at : at + 256] = np.sqrt(max(2 - 2 * threshold, 0)) * apart / 2 + SLACK
    return found


def visits(unit, pivots, margin):
    """Each unit vector's home, and which cells it visits."""
    import numpy as np

    home, visited = np.empty(len(unit), np.int64), np.empty((len(unit), len(pivots)), bool)
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ pivots.T
        best = home[at : at + 512] = near.argmax(axis=1)
        visited[at : at + 512] = near + margin[best] >= near.max(axis=1, keepdims=True)
    return home, visited


def _assigner(pivots, threshold: float):
    def assign(batches):
        import numpy as np
        import pyarrow as pa

        margin = {size: margins(p, threshold) for size, p in pivots.value.items()}
        for batch in batches:
            node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "n"))
            for rows, x in _vectors(batch.column("v")):
                size = x.shape[1]
                unit = unit_of(x)
                best, visited = visits(unit, pivots.value[size], margin[size])
                codes, factors = encode(unit)
                who, cell = np.nonzero(visited)
                home = best[who] == cell
                lists = np.split(cell, np.cumsum(np.bincount(who, minlength=len(x)))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(who), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(best[who].astype(np.int32)),
                        pa.array(node[rows][who]), pa.array(n[rows][who]),
                        pa.array([x[i].tobytes() if h else None for i, h in zip(who, home)], pa.binary()),
                        pa.array([codes[i].tobytes() for i in who], pa.binary()), pa.array(factors[who].astype(np.float32)),
                        pa.array([lists[i] if h else None for i, h in zip(who, home)], pa.list_(pa.int32())),
                    ],
                    names=["size", "cell", "home", "node", "n", "vec", "code", "factor", "cells"],
                )

    return assign


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (size, cell, home, ...) in blocks of bounded size: homes of a cell by its visitors."""
    count = rows.groupBy("size", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("h"), F.count("*").alias("v"))
    # at most MAX_CELLS rows
    count = F.broadcast(
        count.select("size", "cell", F.ceil(F.col("h") / BLOCK_HOMES).cast("int").alias("hs"), F.ceil(F.col("v") / BLOCK_VISITORS).cast("int").alias("vs"))
    )
    joined = rows.join(count, ["size", "cell"])
    spread = F.xxhash64("node", F.lit(1))
    as_home = joined.where("home = cell").select(
        *rows.columns, F.lit(True).alias("query"), F.pmod(spread, F.col("hs")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("j")
    )
    # a cell without homes has no queries
    as_visitor = joined.where("hs > 0").select(
        *rows.columns, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("i"), F.pmod(spread, F.col("vs")).cast("int").alias("j")
    )
    return as_home.union(as_visitor)


def _matrix(column, dtype):
    import numpy as np

    found = column.to_pylist()
    return np.frombuffer(b"".join(found), dtype).reshape(len(found), -1)


def _survivors(dtype, threshold: float):
    def find(block):
        import numpy as np
        import pyarrow as pa

        query = block.column("query").to_numpy().astype(bool)
        homes, visitors = block.filter(pa.array(query)), block.filter(pa.array(~query))
        kept = np.zeros(len(visitors), bool)
        if len(homes) and len(visitors):
            bounds = upper_bounds(unit_of(_matrix(homes.column("vec"), dtype)), _matrix(visitors.column("code"), np.uint8), visitors.column("factor").to_numpy())
            other = homes.column("node").to_numpy()[:, None] != visitors.column("node").to_numpy()[None, :]
            kept = ((bounds >= threshold) & other).any(axis=0)
        return visitors.filter(pa.array(kept)).select(["size", "cell", "home", "node"])

    return find


def _exact(dtype, threshold: float):
    def link(block):
        import numpy as np
        import pyarrow as pa

        query = block.column("query").to_numpy().astype(bool)
        homes, visitors = block.filter(pa.array(query)), block.filter(pa.array(~query))
        out: list = [np.zeros(0, np.int64)] * 3
        if len(homes) and len(visitors):
            hn, vn = homes.column("node").to_numpy(), visitors.column("node").to_numpy()
            cosines = unit_of(_matrix(homes.column("vec"), dtype)) @ unit_of(_matrix(visitors.column("vec"), dtype)).T
            h, v = np.nonzero((cosines >= threshold) & (hn[:, None] != vn[None, :]))
            if len(h):
                weights_h, weights_v = homes.column("n").to_numpy(), visitors.column("n").to_numpy()
                # a visitor that this home doesn't visit in turn can't find the link itself
                alone = np.ones((len(hn), int(visitors.column("home").to_numpy().max()) + 1), bool)
                for row, cells in enumerate(homes.column("cells").to_pylist()):
                    cells = np.array(cells)
                    alone[row, cells[cells < alone.shape[1]]] = False
                blind = alone[h, visitors.column("home").to_numpy()[v]]
                sums_h = np.bincount(h, weights_v[v], len(hn)).astype(np.int64)
                sums_v = np.bincount(v[blind], weights_h[h[blind]], len(vn)).astype(np.int64)
                first = np.full(len(vn), -1)
                first[v[::-1]] = h[::-1]  # a home of each linked visitor
                met = np.flatnonzero(first >= 0)
                same = np.unique(np.stack((h, first[v])), axis=1)
                counted = [(np.zeros(int((s > 0).sum()), np.int64), n[s > 0], s[s > 0]) for n, s in ((hn, sums_h), (vn, sums_v))]
                edges = [(np.ones(len(a), np.int64), a, b) for a, b in ((vn[met], hn[first[met]]), (hn[same[0]], hn[same[1]]))]
                out = [np.concatenate(x) for x in zip(*counted, *edges)]
        return pa.table([pa.array(x) for x in out], names=["edge", "a", "b"])

    return link


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id."""
    import numpy as np

    spark = rows.sparkSession
    common.bounded_batches(spark)
    double = isinstance(rows.schema[embedding].dataType.elementType, T.DoubleType)
    kind, dtype = ("double", np.float64) if double else ("float", np.float32)
    v = F.col(embedding).cast(f"array<{kind}>")
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.coalesce((length > 0) & (length < float("inf")), F.lit(False))  # null, NaN and zero fail
    own = rows.select(F.col(vec_id).alias("vec_id"), v.alias("v"), good.alias("good")).withColumn("node", F.when(F.col("good"), F.xxhash64("v")))
    nodes = common.cut(own.where("good").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    total = nodes.count()
    cells = max(1, min(MAX_CELLS, total // CELL_VECTORS))
    pivots: dict = {}
    for row in nodes.select("node", "v").orderBy("node").limit(cells).collect():  # MAX_CELLS at most
        pivots.setdefault(len(row["v"]), []).append(row["v"])
    for row in nodes.groupBy(F.size("v").alias("size")).agg(F.first("v").alias("v")).collect():  # one for each length
        pivots.setdefault(row["size"], [row["v"]])
    shared = spark.sparkContext.broadcast({size: unit_of(np.array(x, dtype)) for size, x in pivots.items()})
    assigned = nodes.select("node", "n", "v").mapInArrow(_assigner(shared, threshold), ASSIGNED)
    found = (
        _dealt(assigned)
        .groupBy("size", "cell", "i", "j")
        .applyInArrow(_survivors(dtype, threshold), "size int, cell int, home int, node long")
        .distinct()
    )
    homes = assigned.where("home = cell").select("size", "cell", "home", "node", "n", "vec", "cells")
    packed = homes.select(F.col("node").alias("own"), F.col("n"), "vec")
    visitors = found.join(packed, F.col("node") == F.col("own")).select("size", "cell", "home", "node", "n", "vec", F.lit(None).cast("array<int>").alias("cells"))
    met = visitors.select("size", "cell").distinct().select(F.col("size").alias("s"), F.col("cell").alias("c"))
    needed = homes.join(F.broadcast(met), (F.col("size") == F.col("s")) & (F.col("cell") == F.col("c")), "left_semi")
    both = needed.withColumn("q", F.lit(True)).union(visitors.withColumn("q", F.lit(False)))
    count = both.groupBy("size", "cell").agg(F.count_if("q").alias("h"), F.count_if(~F.col("q")).alias("v"))
    count = F.broadcast(count.select("size", "cell", F.ceil(F.col("h") / BLOCK_HOMES).cast("int").alias("hs"), F.ceil(F.col("v") / BLOCK_VISITORS).cast("int").alias("vs")))
    spread, columns = F.xxhash64("node", F.lit(1)), ["size", "cell", "home", "node", "n", "vec", "cells"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        needed.join(count, ["size", "cell"]).select(*columns, F.lit(True).alias("query"), F.pmod(spread, F.col("hs")).cast("int").alias("i"), upto("vs").alias("j"))
    ).union(visitors.join(count, ["size", "cell"]).select(*columns, F.lit(False).alias("query"), upto("hs").alias("i"), F.pmod(spread, F.col("vs")).cast("int").alias("j")))
    told = common.cut(dealt.groupBy("size", "cell", "i", "j").applyInArrow(_exact(dtype, threshold), "edge long, a long, b long"))
    links = told.where("edge = 0").groupBy(F.col("a").alias("linked")).agg(F.sum("b").alias("links"))
    roots = common.components(told.where("edge = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = nodes.select("node", "n", "least").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    rooted = rooted.select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a renewed key, so that a class with very many vectors may be split
    least = least.select(F.col("root").bitwiseXOR(F.lit(1)).alias("top"), "component_id")
    known = (
        rooted.join(least, F.col("root").bitwiseXOR(F.lit(1)) == F.col("top"))
        .join(links, F.col("node") == F.col("linked"), "left")
        .select(F.col("node").bitwiseXOR(F.lit(1)).alias("at"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    )
    joined = own.select("vec_id", "node").join(known, F.col("node").bitwiseXOR(F.lit(1)) == F.col("at"), "left")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op7_rotated_codes(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (
  SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
top AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM top
"""
