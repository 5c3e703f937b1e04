"""A stream of listings, turned into what happened to each path: added, changed, deleted.

A listing is a set of rows (path, mtime, listed): all that was there at the time `listed`. Each path keeps the time it was last listed and its
mtime, and sets a timer just after. A later listing moves event time on; if it has the path, the timer is set anew, else it goes off, and the
path was deleted. State is in the state store, and comes back from the checkpoint after a restart.

Calls, state and timers are those of buckets of paths, by a hash, as one call a path costs milliseconds; results are those of each path on its own.
A call holds one bucket, a share of 1 / BUCKETS of the paths. A checkpoint belongs to its number of buckets.

A timer goes off once the watermark has passed it, in the batch after the listing that lacks the path; with `availableNow`, one more (empty)
listing or run lets it. Listings must come in the order of their times, one a batch (with several in a batch, a path that only one of the earlier ones lacks isn't seen
to go); of rows with one path in one listing, the greatest mtime counts. Rows without a path or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "path string, status string, mtime double, listed timestamp"
#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.session.timeZone": "UTC"}
LISTING = "path string, mtime double, listed timestamp"
#: Groups of paths that share their state: few, so that their calls cost little, yet more than a cluster has cores; of 4 million paths one has 4,000.
BUCKETS = 1024


class _Buckets(StatefulProcessor):
    """State of a bucket: its paths, with the mtime and the time that each was last listed with, and a timer for each such time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "paths array<string>, mtimes array<double>, listed array<long>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        seen: dict = {}
        for frame in rows:
            for path, mtime, listed in zip(frame["path"].tolist(), frame["mtime"].tolist(), _micros(frame["listed"])):
                other = seen.get((listed, path))
                if other is None or other != other or mtime > other:  # the greatest, a null only if there is nothing else
                    seen[listed, path] = mtime
        known = self._known()
        timers = {_after(listed) for _, listed in known.values()}
        out = _gone(known, timerValues.getCurrentWatermarkInMs())  # a listing between didn't have these
        for (listed, path), mtime in sorted(seen.items(), key=lambda x: x[0][0]):
            if path not in known:
                out.append((path, "added", mtime, listed))
            elif known[path][0] != mtime:
                out.append((path, "changed", mtime, listed))
            known[path] = (mtime, listed)
        self._keep(known, timers)
        yield from _frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        known = self._known()
        out = _gone(known, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(known, {_after(listed) for _, listed in known.values()})
        yield from _frames(out)

    def close(self) -> None:
        pass

    def _known(self) -> dict:
        return {path: (mtime, listed) for path, mtime, listed in zip(*self.last.get())} if self.last.exists() else {}

    def _keep(self, known: dict, timers: set) -> None:
        """Store what is known; `timers` are set, those of what is known shall be."""
        wanted = {_after(listed) for _, listed in known.values()}
        for at in timers - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - timers:
            self.handle.registerTimer(at)
        if known:
            self.last.update((list(known), [mtime for mtime, _ in known.values()], [listed for _, listed in known.values()]))
        else:
            self.last.clear()


def _gone(known: dict, now: int) -> list:
    """Take out of `known` the paths whose timers went off by `now`; their events."""
    gone = [(path, "deleted", mtime, _after(listed) * 1000) for path, (mtime, listed) in known.items() if _after(listed) <= now]
    for path, *_ in gone:
        del known[path]
    return gone


def _frames(events: list) -> Iterator:
    import pandas as pd

    if events:
        frame = pd.DataFrame(events, columns=["path", "status", "mtime", "listed"])
        yield frame.assign(listed=pd.to_datetime(frame["listed"], unit="us"))


def _micros(times) -> list:
    """Microseconds of a column of times (in UTC, as SETTINGS have it)."""
    return times.to_numpy("datetime64[us]").astype("int64").tolist()


def _after(listed: int) -> int:
    """Milliseconds of the timer of a listing, whose time is in microseconds."""
    return listed // 1000 + 1


def changes(listings: DataFrame) -> DataFrame:
    """Stream of (path, mtime, listed) -> (path, status, mtime, listed). The session must have SETTINGS."""
    for key, value in SETTINGS.items():
        if listings.sparkSession.conf.get(key, None) != value:
            raise ValueError(f"set {key} to {value}")
    named = listings.where("path is not null and listed is not null").select("path", F.col("mtime").cast("double"), "listed")
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket")
    return named.withWatermark("listed", "0 seconds").select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        _Buckets(), outputStructType=EVENTS, outputMode="Append", timeMode="eventTime"
    )


def follow(spark: SparkSession, source: str, output: str, checkpoint: str) -> DataFrame:
    """Take in the listings that are new under source (a Parquet file each), append their events under output; returns all events."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        # one listing a batch, in the order in which they were written
        stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(source)
        query = changes(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(output)
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(EVENTS).parquet(output)
