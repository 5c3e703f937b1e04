"""Shared pieces: word splitting, bounded Arrow batches, hashed folds and connected components.

Words are runs of anything but ASCII white space (space and 0x09-0x0D). `bytes.split()` splits on
exactly those six bytes, and UTF-8 never uses them inside a longer character.
"""

from __future__ import annotations

import gc
import os
import time
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.session import ensure_checkpoint_dir

#: Bytes that one Arrow batch may hold, so that very long texts cannot fill a worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def release() -> None:
    """Give freed memory back to the system. Workers wait for their next task, and what they hold counts against their node."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


_KEPT: dict = {}


def worker_cache(function):
    """One result, kept in each worker for the tasks of its own operator."""
    cached = _KEPT[function.__module__] = lru_cache(maxsize=2)(function)
    return cached


def make_room(module: str) -> None:
    """Drop what other operators keep in this worker: its next task may be anyone's."""
    others = [cached for owner, cached in _KEPT.items() if owner != module and cached.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        gc.unfreeze()
        gc.collect()
        release()


def tidy(function):
    """A function over batches that gives memory back when its task ends, and has what other operators keep dropped when it begins."""

    def tidied(batches):
        make_room(function.__module__)
        try:
            yield from function(batches)
        finally:
            release()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(array) -> list[bytes]:
    """The batch's texts as UTF-8, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    return [x if x is not None else b"" for x in array.cast(kind).to_pylist()]


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder; lost executors then cost nothing but their tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds that py4j may take to hand over what Python let go of: its thread for that looks once a second.
HANDOVER_S = 1.5


def drop_past(spark: SparkSession, wait: bool = False) -> None:
    """Let the driver's cleaner find the shuffles, broadcasts and checkpoints that nothing refers to any more; it only hears of them by a
    collection, and Python's references stand in cycles, so they take one too. wait: those just let go of count as well."""
    for _ in range(2 if wait else 1):
        gc.collect()
        time.sleep(HANDOVER_S if wait else 0)
        spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, cut, with a broadcast hint if it has at most so many rows; beyond that Spark deals it out."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, ...) with the least (m) around u. The key is renewed, so that a hub with very many edges may be split.

    The hint keeps small rounds from being broadcast by way of the driver.
    """
    key = F.col("u").bitwiseXOR(F.lit(1))
    right = least.select(key.alias("w"), "m").hint("shuffle_hash")
    return edges.join(right, key == F.col("w"))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step: edges (u, v), each once with u > v."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # u's smaller neighbours, and u itself, hang from the least of them
        moved = _with_least(edges, least).select(F.col("v").alias("a"), F.col("m").alias("b"))
        pairs = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        # u's larger neighbours hang from the least around u
        pairs = _with_least(both.where("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (
        pairs.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


#: Distinct edges up to which one task finds the components: rounds of shuffles would cost more than they are worth.
SMALL_EDGES = 1 << 17


def _small_components(batches):
    import pyarrow as pa

    links = UnionFind()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            links.join(u, v)
    nodes = list(links.up.keys() | {links.find(x) for x in links.up})
    for at in range(0, len(nodes), 4096):
        part = nodes[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([links.find(x) for x in part], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids by alternating large and small stars.

    edges has long columns u, v. Returns (node, root): every node of an edge, root being the least
    node that it reaches. Up to `SMALL_EDGES` distinct edges go to one task. Beyond that each round is two group-bys and joins, and is
    checkpointed; no link list is ever brought to the driver (it sees a count and a checksum a round).
    """
    current = cut(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if current.count() <= SMALL_EDGES:
        return current.coalesce(1).mapInArrow(tidy(_small_components), "node long, root long")
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark["n"] == 0 or seen == (mark["n"], mark["s"]):
            break
        seen = (mark["n"], mark["s"])
        current = cut(_stars(_stars(current, small=False), small=True))
        drop_past(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


class UnionFind:
    """Small, within one task: links of one bounded block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: installed beside Python on every worker, or in $TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def struct(spec: str) -> T.StructType:
    """A struct type from "name type, ..."; works at import, without a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(","))])
