"""Incremental indexing: snapshots compared by time, and a stream of changed files that is merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ctxspark.sources.store import Store


def status(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): deleted, added, changed or unchanged, by path and mtime (a stored null counts as changed)."""
    old = tracked.select("path", F.col("mtime").alias("old"), F.lit(True).alias("was"))
    new = current.select("path", F.col("mtime").alias("new"), F.lit(True).alias("is"))
    return old.join(new, "path", "full_outer").select(
        "path",
        F.when(F.col("is").isNull(), "deleted")
        .when(F.col("was").isNull(), "added")
        .when(F.col("old").eqNullSafe(F.col("new")) & F.col("old").isNotNull(), "unchanged")
        .otherwise("changed")
        .alias("status"),
    )


def follow(changes: DataFrame, store: Store, table: str, checkpoint: str, order: str, available_now: bool = True) -> StreamingQuery:
    """Merge a stream of rows of `table` into the store; per key the row with the greatest `order` of a batch wins.

    A batch that is repeated after a failure writes the same rows again. Deletions don't show in a stream of files: compare
    snapshots with status() from time to time.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.upsert(table, batch, order if order in batch.columns else None)

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
