"""Cosine similarity in double precision, and exact top-k search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Vectors that a task compares with a block of queries at once.
SLICE = 1_024


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty, null, or zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(same & (norm > 0), _dot(a, b) / norm), F.lit(0.0))


def literal_vector(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vectors: DataFrame, query, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    scored = vectors.select(key, cosine(F.col(embedding), literal_vector(query)).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_all(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Top k of all vectors for each query: query_id, key, score.

    The queries are taken in blocks of bounded size; a block is broadcast, and each task keeps only its best k per query before
    anything is shuffled. Queries without a key are left out; a cosine that isn't defined counts as 0.
    """
    import numpy as np

    spark = vectors.sparkSession
    queries = queries.where(F.col(key).isNotNull())
    total = queries.count()
    parts = max(1, -(-total // block))
    found = None
    for part in range(parts):
        chosen = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else queries
        rows = chosen.select(key, embedding).collect()  # one block
        held = spark.sparkContext.broadcast(([r[0] for r in rows], [np.array(r[1] if r[1] is not None else [], np.float64) for r in rows]))
        own = vectors.select(key, embedding).mapInPandas(_best(held, k, key, embedding), f"query_id long, {key} long, score double")
        found = own if found is None else found.union(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(held, k: int, key: str, embedding: str):
    def best(frames):
        import numpy as np
        import pandas as pd

        ids, queries = held.value
        ids = np.array(ids, np.int64)
        by_size: dict[int, list[int]] = {}
        for i, q in enumerate(queries):
            by_size.setdefault(len(q), []).append(i)
        by_size.pop(0, None)
        stacked = {size: np.stack([queries[i] for i in own]) for size, own in by_size.items()}
        kept: pd.DataFrame | None = None
        # a table of scores has a block of queries times SLICE vectors, however many an Arrow batch has
        for frame in (whole.iloc[at : at + SLICE] for whole in frames for at in range(0, len(whole), SLICE)):
            vectors = [np.array(v if v is not None else [], np.float64) for v in frame[embedding]]
            sizes = np.array([len(v) for v in vectors])
            keys = frame[key].to_numpy()
            scores = np.zeros((len(ids), len(vectors)))
            for size, q in stacked.items():
                same = np.flatnonzero(sizes == size)
                if len(same):
                    x = np.stack([vectors[i] for i in same])
                    norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                    with np.errstate(invalid="ignore", over="ignore"):
                        scores[np.ix_(by_size[size], same)] = np.nan_to_num(np.divide(q @ x.T, norm, out=np.zeros(norm.shape), where=norm > 0), nan=0.0)
            if len(vectors) > k:  # all scores that reach the k-th best, ties too
                least = np.partition(scores, len(vectors) - k, axis=1)[:, len(vectors) - k]
                row, column = np.nonzero(scores >= least[:, None])
            else:
                row, column = (x.ravel() for x in np.indices(scores.shape))
            own = pd.DataFrame({"query_id": ids[row], key: keys[column], "score": scores[row, column]})
            both = own if kept is None else pd.concat([kept, own])
            kept = both.sort_values(["score", key], ascending=[False, True]).groupby("query_id").head(k)
        if kept is not None:
            yield kept

    return best
