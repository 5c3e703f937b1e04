"""The index's tables: written by appending, and counted by the list of files.

Each row belongs to a file and to the version of the index that wrote it. A build appends its rows under `version=N` and, as its last
write, one row of `commits`. That row names the list of files that holds from then on; the list says for every file which version of its rows
counts, so rows of changed and deleted files drop out of a join without being touched. What a build writes grows with what changed (and with the
list, one short row a file); a build that fails leaves rows that no commit names, and the last commit stays readable. Readers keep what they
began with: a table is read through the commit that was the last when it was opened.

`compact` writes the rows that count once more, under one version, and drops older ones. One writer at a time.

Postings are partitioned by a bucket of the term, so a search reads its terms' buckets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.session import ensure_checkpoint_dir

BUCKETS = 16
#: Versions after which a build compacts.
MAX_VERSIONS = 32

SCHEMAS = {
    "chunks": "file string, id string, type string, name string, signature string, code string, hash string, summary string, ord int",
    "embeddings": "file string, chunk_id string, vector array<float>",
    "postings": "file string, term string, n long, max_tf long, min_dl int, max_dl int, found array<struct<id:string,tf:bigint,dl:int>>",
    "specifiers": "file string, specifier string, base string",
    "edges": "file string, target_file string",
}
FILES = "path string, mtime double, chunks long, tokens long, version long, edges_version long"
RANKS = "file string, steps array<double>"
COMMIT = "files long, ranks long, n_files long, n_chunks long, n_tokens long"
#: What a table is looked up by: rows are sorted by it, and each row group has a Bloom filter of it.
KEYS = {"chunks": "id", "embeddings": "chunk_id", "specifiers": "file", "edges": "file"}
#: Further options of the Parquet writer.
OPTIONS: dict[str, str] = {}
#: The column of the list of files that says which version of a table's rows counts.
COUNTS_BY = {"edges": "edges_version"}


@dataclass(frozen=True)
class Commit:
    """The last commit: where its list of files and its ranks are, and sizes of the corpus."""

    version: int = 0
    files: int = 0
    ranks: int = 0
    n_files: int = 0
    n_chunks: int = 0
    n_tokens: int = 0


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        ensure_checkpoint_dir(spark)

    # --- folders, by Hadoop's file systems, as paths may be remote

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str, done: bool = True) -> list[int]:
        """Versions of a table, ascending; `done`: only whole ones."""
        where, system = self._path(table)
        if not system.exists(where):
            return []
        names = [x.getPath().getName() for x in system.listStatus(where)]
        found = sorted(int(m.group(1)) for m in (re.fullmatch(r"version=(\d+)", n) for n in names) if m)
        return [v for v in found if not done or system.exists(self._path(f"{table}/version={v}/_SUCCESS")[0])]

    def _delete(self, path: str) -> None:
        where, system = self._path(path)
        system.delete(where, True)

    def clear(self) -> None:
        self._delete("")

    # --- reading

    def last(self) -> Commit:
        found = self._versions("commits")
        if not found:
            return Commit()
        row = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits/version={found[-1]}").first()
        return Commit(found[-1], **row.asDict())

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def files(self, at: Commit | None = None) -> DataFrame:
        at = at or self.last()
        return self.spark.read.schema(FILES).parquet(f"{self.root}/files/version={at.files}") if at.version else self._none(FILES)

    def ranks(self, at: Commit | None = None) -> DataFrame:
        at = at or self.last()
        return self.spark.read.schema(RANKS).parquet(f"{self.root}/ranks/version={at.ranks}") if at.ranks else self._none(RANKS)

    def rows(self, table: str, at: Commit | None = None) -> DataFrame:
        """Rows that count, with their file; a table's partition columns can be filtered before the join."""
        return self.valid(table, self.stored(table), at)

    def stored(self, table: str) -> DataFrame:
        """All rows, those that don't count as well, with `version` (and `bucket` of postings)."""
        schema = SCHEMAS[table] + ", version long" + (", bucket int" if table == "postings" else "")
        where, system = self._path(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if system.exists(where) else self._none(schema)

    def valid(self, table: str, stored: DataFrame, at: Commit | None = None) -> DataFrame:
        """Rows of stored() that count."""
        counts = F.col(COUNTS_BY.get(table, "version"))
        kept = self.files(at).select(F.col("path").alias("file"), counts.alias("version"))
        return stored.join(kept, ["file", "version"]).drop("version")

    def lookup(self, table: str, key: str, at: Commit | None = None) -> DataFrame:
        """Rows of one key. Row groups that can't have it are skipped, by their bounds or their Bloom filter."""
        return self.valid(table, self.stored(table).where(F.col(KEYS[table]) == key), at)

    def table(self, name: str, at: Commit | None = None) -> DataFrame:
        """A table as its users know it."""
        if name == "files":
            return self.files(at).select("path", "mtime")
        if name == "graph":
            return self.rows("edges", at).select(F.col("file").alias("source_file"), "target_file").distinct()
        if name == "embeddings":
            return self.rows(name, at).select("chunk_id", "vector")
        return self.rows(name, at).select(*[c.split()[0] for c in SCHEMAS[name].split(", ") if " " in c and not c.startswith("found")])

    # --- writing

    def write(self, table: str, rows: DataFrame, version: int, small: bool = False) -> DataFrame:
        """Append rows under a version that isn't committed; returns them read back. What an earlier failure left there is replaced."""
        path = f"{self.root}/{table}/version={version}"
        rows = rows.coalesce(1) if small else rows
        if table == "postings":
            rows = rows.withColumn("bucket", bucket_of(F.col("term")))
            # as many tasks a bucket as the session has partitions for it
            parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
            rows = (rows if small else rows.repartition("bucket", F.pmod(F.xxhash64("file"), F.lit(parts)))).sortWithinPartitions("bucket", "term")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
        else:
            key = KEYS[table]
            kept = rows.sortWithinPartitions(key).write.mode("overwrite").options(**OPTIONS)
            # a filter has a least size, so a few rows have none: their bounds do
            (kept if small else kept.option(f"parquet.bloom.filter.enabled#{key}", "true")).parquet(path)
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def write_files(self, files: DataFrame, version: int, small: bool = False) -> DataFrame:
        path = f"{self.root}/files/version={version}"
        (files.coalesce(1) if small else files).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(FILES).parquet(path)

    def write_ranks(self, ranks: DataFrame, version: int) -> None:
        ranks.write.mode("overwrite").parquet(f"{self.root}/ranks/version={version}")

    def commit(self, new: Commit, before: Commit) -> None:
        """From here on `new` holds. Lists and ranks that neither it nor the commit before names are dropped."""
        names = [c.split()[0] for c in COMMIT.split(", ")]
        row = self.spark.range(1, numPartitions=1).select(*[F.lit(getattr(new, n)).cast("long").alias(n) for n in names])
        row.write.mode("overwrite").parquet(f"{self.root}/commits/version={new.version}")
        for table, kept in (("files", {new.files, before.files}), ("ranks", {new.ranks, before.ranks}), ("commits", {new.version, before.version})):
            for version in self._versions(table, done=False):
                if version not in kept:
                    self._delete(f"{table}/version={version}")

    def compact(self) -> None:
        """Write the rows that count under one new version, and drop the others."""
        old = self.last()
        new = old.version + 1
        for table in SCHEMAS:
            self.write(table, self.rows(table, old).drop("bucket"), new)
        at = F.lit(new).cast("long")
        self.write_files(self.files(old).withColumns({"version": at, "edges_version": at}), new)
        self.commit(Commit(new, new, old.ranks, old.n_files, old.n_chunks, old.n_tokens), old)
        for table in SCHEMAS:
            for version in self._versions(table, done=False):
                if version < new:
                    self._delete(f"{table}/version={version}")

    def compact_if_many(self) -> None:
        if len(self._versions("edges", done=False)) > MAX_VERSIONS:
            self.compact()


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")
