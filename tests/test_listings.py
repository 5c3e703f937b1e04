"""Listings as a stream: every change of every listing, deletions among them, with restarts between."""

import random

import pytest
from pyspark.sql import functions as F

from ctxspark.streaming import incremental, listings


def put(spark, folder, hour, rows):
    frame = spark.createDataFrame([(p, m) for p, m in rows], "path string, mtime double")
    frame.withColumn("listed", F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    found = listings.follow(spark, *(str(tmp_path / x) for x in ("in", "out", "checkpoint")))
    return sorted((r["listed"].hour, r["path"], r["status"]) for r in found.collect())


def test_listings_one_by_one(spark, tmp_path):
    """Each run begins from the checkpoint, and every listing's events are those of snapshots compared."""
    r = random.Random(1)
    before, expected = {}, []
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for hour in range(1, 6):
        now = {f"p{i}": float(r.randint(1, 2)) for i in range(12) if r.random() < 0.6}
        put(spark, str(tmp_path / "in"), hour, now.items())
        frames = [spark.createDataFrame(list(x.items()), "path string, mtime double") for x in (before, now)]
        status = incremental.status(*frames).where("status <> 'unchanged'").collect()
        # deletions carry the time just after the last listing with the path, which here is the one before
        expected += [(hour - (x["status"] == "deleted"), x["path"], x["status"]) for x in status]
        assert run(spark, tmp_path) == sorted(expected)
        before = now
    assert run(spark, tmp_path) == sorted(expected)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_a_path_that_comes_back_and_hard_rows(spark, tmp_path):
    """Several listings wait: a path that one of them lacks goes and comes. Null paths and mtimes, repeated rows."""
    put(spark, str(tmp_path / "in"), 1, [("a", 1.0), ("b", 1.0), ("b", 2.0), (None, 1.0)])
    put(spark, str(tmp_path / "in"), 2, [("b", 2.0)])
    put(spark, str(tmp_path / "in"), 3, [("a", 1.0), ("b", 2.0)])
    put(spark, str(tmp_path / "in"), 4, [("a", 1.0), ("b", 3.0)])
    assert run(spark, tmp_path) == [(1, "a", "added"), (1, "a", "deleted"), (1, "b", "added"), (3, "a", "added"), (4, "b", "changed")]


def test_paths_share_calls_and_state(spark, tmp_path, monkeypatch):
    """State and timers are a few buckets', however many paths there are; each path has its own events all the same."""
    monkeypatch.setattr(listings, "BUCKETS", 8, raising=False)
    put(spark, str(tmp_path / "in"), 1, [(f"p{i}", 1.0) for i in range(300)])
    put(spark, str(tmp_path / "in"), 2, [(f"p{i}", 1.0 + (i % 5 == 0)) for i in range(300) if i % 3])
    put(spark, str(tmp_path / "in"), 3, [(f"p{i}", 1.0 + (i % 5 == 0)) for i in range(300) if i % 4])
    expected = [(1, f"p{i}", "added") for i in range(300)] + [(1, f"p{i}", "deleted") for i in range(300) if i % 3 == 0]
    expected += [(2, f"p{i}", "changed") for i in range(300) if i % 3 and i % 5 == 0] + [(2, f"p{i}", "deleted") for i in range(300) if i % 3 and i % 4 == 0]
    expected += [(3, f"p{i}", "added") for i in range(300) if i % 3 == 0 and i % 4]
    assert run(spark, tmp_path) == sorted(expected)
    # what the store holds: 225 paths
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", listings.STATE_STORE)
    try:
        assert 0 < spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "checkpoint")).count() <= 8
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_settings_are_asked_for(spark):
    with pytest.raises(ValueError, match="providerClass"):
        listings.changes(spark.readStream.format("rate").load().selectExpr("'a' as path", "1.0 as mtime", "timestamp as listed"))
