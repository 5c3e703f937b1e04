"""The index store: five Parquet tables below one folder.

chunks, embeddings and files are partitioned by a bucket of their key, and a write replaces whole buckets (dynamic partition
overwrite): all rows of a touched bucket are merged, checkpointed, then written over it. Deletes leave an emptied bucket's old
files unless they are overwritten, so they rewrite touched buckets one by one as well, and drop those left without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.session import ensure_checkpoint_dir

BUCKETS = 64


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S = T.StringType()
SCHEMAS = {
    "chunks": _struct(
        ("id", S), ("file", S), ("type", S), ("name", S), ("signature", S), ("code", S), ("hash", S), ("summary", S), ("ord", T.IntegerType())
    ),
    "embeddings": _struct(("chunk_id", S), ("vector", T.ArrayType(T.FloatType()))),
    "graph": _struct(("source_file", S), ("target_file", S)),
    "meta": _struct(("key", S), ("value", S)),
    "files": _struct(("path", S), ("mtime", T.DoubleType()), ("hash", S)),
}
KEYS = {"chunks": "id", "embeddings": "chunk_id", "graph": None, "meta": "key", "files": "path"}


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base with new's rows in the place of those with the same key; of new's rows with one key any is as good: pass them unique."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def last_per_key(new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what repeated single upserts would leave."""
    rest = [c for c in new.columns if c != key]
    return new.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def remove_file(chunks: DataFrame, embeddings: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a file's chunks, their embeddings and the file's row."""
    gone = chunks.where(F.col("file") == path).select(F.col("id").alias("chunk_id"))
    return chunks.where(F.col("file") != path), embeddings.join(gone, "chunk_id", "left_anti"), files.where(F.col("path") != path)


def remove_chunks_for_file(chunks: DataFrame, embeddings: DataFrame, path: str, compat_like: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without the chunks of files equal to or ending in path, and their embeddings.

    compat_like: path's own _ and % are wildcards, and case doesn't count.
    """
    hit = (F.col("file") == path) | (F.col("file").ilike("%" + path) if compat_like else F.col("file").endswith(path))
    gone = chunks.where(hit).select(F.col("id").alias("chunk_id"))
    return chunks.where(~hit), embeddings.join(gone, "chunk_id", "left_anti")


def without_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        ensure_checkpoint_dir(spark)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _stored(self, table: str) -> DataFrame:
        schema, key = SCHEMAS[table], KEYS[table]
        if key is not None:
            schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self._path(table)) if self._exists(table) else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        found = self._stored(name)
        return found.select(*SCHEMAS[name].names)

    def lookup(self, name: str, value: str) -> DataFrame:
        """One row by its key: one bucket is read."""
        key = KEYS[name]
        # the bucket is a constant to the optimizer, so partitions are pruned and no job is needed to hash the key
        bucket = F.pmod(F.xxhash64(F.lit(value)), F.lit(BUCKETS)).cast("int")
        return self._stored(name).where((F.col("bucket") == bucket) & (F.col(key) == value)).select(*SCHEMAS[name].names)

    def _write(self, table: str, rows: DataFrame) -> None:
        key = KEYS[table]
        rows = rows.select(*SCHEMAS[table].names).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        (
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(self._path(table))
        )

    def upsert(self, table: str, new: DataFrame, order: str | None = None) -> None:
        key = KEYS[table]
        new = new.select(*SCHEMAS[table].names)
        new = last_per_key(new, key, order) if order else new.dropDuplicates([key])
        new = new.checkpoint()
        touched = new.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
        base = self._stored(table).join(F.broadcast(touched), "bucket", "left_semi").select(*SCHEMAS[table].names)
        self._write(table, upsert(base, new, key).checkpoint())

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows whose key is in `keys` (one column, named like the key)."""
        key = KEYS[table]
        keys = keys.select(key).distinct().checkpoint()
        touched = keys.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
        left = self._stored(table).join(F.broadcast(touched), "bucket", "left_semi").join(keys, key, "left_anti").checkpoint()
        empty = {r[0] for r in touched.collect()} - {r[0] for r in left.select("bucket").distinct().collect()}  # BUCKETS rows at most
        if len(left.head(1)):
            self._write(table, left)
        for bucket in empty:
            self._delete(f"{self._path(table)}/bucket={bucket}")

    def remove_file(self, path: str) -> None:
        gone = self.table("chunks").where(F.col("file") == path).select("id").checkpoint()
        self.delete("embeddings", gone.withColumnRenamed("id", "chunk_id"))
        self.delete("chunks", gone)
        self.delete("files", self.spark.createDataFrame([(path,)], "path string"))

    def save_graph(self, edges: DataFrame) -> None:
        """Replace all edges."""
        edges.select("source_file", "target_file").distinct().checkpoint().write.mode("overwrite").parquet(self._path("graph"))

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]))

    def get_meta(self, key: str) -> str | None:
        row = self.lookup("meta", key).first()
        return row["value"] if row else None

    def clear(self) -> None:
        for table in SCHEMAS:
            self._delete(self._path(table))
