"""Exact vector search by inverted lists: vectors near a centroid share a list, and lists that can't hold one of the k best aren't read.

Angles obey the triangle inequality. With t the angle between a query and a list's centroid, and least and most the angles of the list's vectors
to it, every vector of the list is at an angle of at least max(t - most, least - t, 0) and at most t + most from the query. A query
first reads its nearest lists until they have k vectors; the k-th best of these is a floor. Of the other lists it reads only those
whose bound reaches the floor, so the result is that of all vectors, ties included.

Centroids come from a sample (`SAMPLE` vectors at most, by a hash of the key); every vector is in a list, and the lists' bounds are of all their
vectors. Lists are cut into blocks of `BLOCK` vectors and queries into blocks of `QUERIES`, so a list with a third of all vectors is many tasks'.

Vectors that are null, empty, zero, not finite or of another length than most have a cosine of 0 with everything; they have a list of their own whose
bound is 0. Queries like that have a cosine of 0 with everything: of all vectors the k least keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.session import ensure_checkpoint_dir

SAMPLE, ROUNDS = 20_000, 8
BLOCK, QUERIES = 4_096, 1_024
#: Visits of lists that a task holds before it sends them on, besides those of one query; and vectors assigned to lists at once.
VISITS, ASSIGNED = 4_096, 1_024
#: List of vectors without a direction.
NOWHERE = -1
#: Angles may be off by rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class Lists:
    """vectors: key, embedding, list, block; centers: one row of a matrix a list; sizes: list -> (vectors, least angle, most angle)."""

    vectors: DataFrame
    centers: list
    sizes: dict
    key: str
    embedding: str


def _units(vectors, size: int):
    """(unit vectors, which of them have a direction) of lists of numbers."""
    import numpy as np

    out = np.zeros((len(vectors), size))
    good = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            x = np.array([math.nan if y is None else y for y in v], np.float64)
            top = np.abs(x).max(initial=0.0)
            if math.isfinite(top) and top > 0:
                x = x / top  # so that squares neither vanish nor overflow
                out[i], good[i] = x / np.sqrt(x @ x), True
    return out, good


def _centers(sample, count: int):
    """Spherical k-means of unit vectors."""
    import numpy as np

    rng = np.random.default_rng(0)
    centers = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centers = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centers)
    return centers


def build(vectors: DataFrame, lists: int | None = None, key: str = "vec_id", embedding: str = "embedding") -> Lists:
    """Inverted lists over all vectors (key, embedding). lists: the square root of their number by default."""
    import numpy as np

    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    vectors = vectors.select(key, embedding)
    total = vectors.count()
    most = F.size(embedding)
    usual = vectors.where(most > 0).groupBy(most.alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 0
    share = max(1, -(-total // SAMPLE))
    # a hash gives a share of about SAMPLE; the limit makes it a bound
    sample = [r[0] for r in vectors.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(embedding).limit(SAMPLE).collect()]
    units, good = _units(sample, size)
    count = lists or max(1, min(4096, math.isqrt(max(total, 1))))
    centers = _centers(units[good], count) if good.any() else np.zeros((0, size))
    held = spark.sparkContext.broadcast(centers)

    def assign(frames):
        import numpy as np
        import pandas as pd

        for frame in (whole.iloc[at : at + ASSIGNED] for whole in frames for at in range(0, len(whole), ASSIGNED)):
            units, good = _units(list(frame[embedding]), size)
            near, angle = np.full(len(frame), NOWHERE), np.zeros(len(frame))
            if len(held.value) and good.any():
                dots = units[good] @ held.value.T
                near[good] = dots.argmax(axis=1)
                angle[good] = np.arccos(np.clip(dots.max(axis=1), -1, 1))
                if len(held.value):
                    angle[~good] = 0.0
            yield pd.DataFrame({key: frame[key], embedding: frame[embedding], "list": near, "angle": angle})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    assigned = vectors.mapInPandas(assign, f"{key} {kinds[key]}, {embedding} {kinds[embedding]}, list int, angle double").checkpoint()
    rows = assigned.groupBy("list").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()  # a row a list
    sizes = {r["list"]: (r["n"], r["least"], r["most"]) for r in rows}
    blocks = F.broadcast(spark.createDataFrame([(k, -(-v[0] // BLOCK)) for k, v in sizes.items()], "list int, blocks int"))
    cut = assigned.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64(key, F.lit(5)), F.col("blocks")).cast("int"))
    return Lists(cut.select(key, embedding, "list", "block", "blocks"), centers.tolist(), sizes, key, embedding)


def _visits(lists: Lists, k: int, floors: bool):
    """Which lists a query reads: at first the nearest with k vectors, then those that the floor leaves."""
    import numpy as np

    centers = np.array(lists.centers)
    names = sorted(lists.sizes)
    table = np.array([lists.sizes[n] for n in names], np.float64).reshape(-1, 3)
    size = centers.shape[1] if centers.ndim == 2 else 0

    def choose(frames):
        import pandas as pd

        for frame in frames:
            units, good = _units(list(frame["q"]), size)
            rows = []
            for i, key in enumerate(frame["query_id"]):
                if good[i]:
                    t = np.arccos(np.clip(units[i] @ centers.T, -1, 1))
                    t = np.array([t[n] if n != NOWHERE else math.pi / 2 for n in names])
                    near = np.maximum(0, np.maximum(t - table[:, 2], table[:, 1] - t)) - SLACK
                    bound = np.where(np.array(names) == NOWHERE, 0.0, np.cos(np.maximum(near, 0)))
                else:  # a cosine of 0 with everything
                    bound = np.zeros(len(names))
                order = np.argsort(-bound, kind="stable")
                have = np.cumsum(table[order, 0])
                first = set(order[: int(np.searchsorted(have, k)) + 1].tolist())
                if floors:
                    floor = frame["floor"].iloc[i]
                    chosen = [j for j in range(len(names)) if j not in first and (math.isnan(floor) or bound[j] >= floor - SLACK)]
                else:
                    chosen = sorted(first)
                rows += [(key, frame["q"].iloc[i], names[j], -(-int(table[j, 0]) // BLOCK)) for j in chosen]
                if len(rows) >= VISITS:  # each has its query's vector
                    yield pd.DataFrame(rows, columns=["query_id", "q", "list", "blocks"])
                    rows = []
            yield pd.DataFrame(rows, columns=["query_id", "q", "list", "blocks"])

    return choose


def _compare(lists: Lists, k: int):
    """The k best of a block of vectors for each query of a block."""
    size, key, embedding = len(lists.centers[0]) if lists.centers else 0, lists.key, lists.embedding

    def best(vectors, queries):
        import numpy as np
        import pandas as pd

        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        (x, some), (q, good) = _units(list(vectors[embedding]), size), _units(list(queries["q"]), size)
        scores = np.where(good[:, None] & some[None, :], q @ x.T, 0.0)
        keys = vectors[key].to_numpy()
        order = np.argsort(keys, kind="stable")
        scores, keys = scores[:, order], keys[order]
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy(), top.shape[1]), key: keys[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()})

    return best


def _scan(lists: Lists, visits: DataFrame, k: int, parts: int) -> DataFrame:
    each = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = each.select(F.col("list").alias("l"), F.col("block").alias("b"), F.col("part").alias("p")).distinct()
    # a block of vectors goes to each block of queries that asks for it
    vectors = lists.vectors.select(lists.key, lists.embedding, "list", "block").join(wanted, (F.col("list") == F.col("l")) & (F.col("block") == F.col("b")))
    left = vectors.select(lists.key, lists.embedding, "l", "b", "p").groupBy("l", "b", "p")
    right = each.select("query_id", "q", "list", "block", "part").groupBy("list", "block", "part")
    return left.cogroup(right).applyInPandas(_compare(lists, k), f"query_id long, {lists.key} long, score double")


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(lists: Lists, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k best vectors for each query (key, embedding); queries without a key are left out."""
    key, embedding = lists.key, lists.embedding
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(embedding).alias("q"))
    kind = dict(asked.dtypes)["q"]
    parts = max(1, -(-asked.count() // QUERIES))
    schema = f"query_id long, q {kind}, list int, blocks int"
    first = _top(_scan(lists, asked.mapInPandas(_visits(lists, k, False), schema), k, parts), k, key).checkpoint()
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = asked.join(floors, "query_id", "left").mapInPandas(_visits(lists, k, True), schema)
    return _top(first.drop("rank").union(_scan(lists, rest, k, parts)), k, key)


def share_read(lists: Lists, queries: DataFrame, k: int) -> float:
    """Of all pairs of a query and a vector, the share whose lists are read."""
    key = lists.key
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(lists.embedding).alias("q"))
    schema = f"query_id long, q {dict(asked.dtypes)['q']}, list int, blocks int"
    first = asked.mapInPandas(_visits(lists, k, False), schema)
    floors = _top(_scan(lists, first, k, 1), k, key).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = asked.join(floors, "query_id", "left").mapInPandas(_visits(lists, k, True), schema)
    sizes = lists.vectors.sparkSession.createDataFrame([(n, v[0]) for n, v in lists.sizes.items()], "list int, n long")
    read = first.union(rest).join(sizes, "list").agg(F.sum("n")).first()[0] or 0
    return read / max(1, asked.count() * sum(v[0] for v in lists.sizes.values()))
