"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `VNODES` places on a ring of 65,536; a row hashes to a place and belongs to the next node clockwise. A shard takes
no more rows than its bound: the rows divided by the shards, rounded down, and one more for as many shards as rows are left. The bounds add
up to the rows, so counts differ by one at most. Rows over a full shard go on clockwise to the next shard with room; all others stay
where the ring put them, so a changed shard count or some more rows move few.

Rows of an arc are ordered by hash. Only counts per arc (and, for large inputs, per part of an arc: `CELL_ROWS` rows each) go
to the driver; it decides how many of each arc's rows stay and where the others go, and rows find their shard and slot by
their rank in the arc. No task ever holds more than a cell.

Defined results: null text is empty; null doc_id is a key like any other (the text's checksum tells such rows apart); repeated rows each
get a slot of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm import common

VNODES = 128
RING_BITS = 16
CELL_ROWS = 500_000
SHARDS = 24


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) in clockwise order, one node at a place."""
    from xxhash import xxh64_intdigest

    nodes: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for v in range(vnodes):
            h = xxh64_intdigest(f"{shard}:{v}".encode())
            place = h >> (64 - RING_BITS)
            nodes[place] = min(nodes.get(place, (h, shard)), (h, shard))
    return sorted((place, shard) for place, (_, shard) in nodes.items())


def place_rows(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges: (arc, first rank, end rank, shard, slot of the first). The bounds are the rows, dealt evenly."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    ranges, over = [], []

    def take(arc: int, done: int, shard: int, n: int) -> None:
        ranges.append((arc, done, done + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for arc in sorted(counts):
        shard = nodes[arc][1]
        n = min(counts[arc], room[shard])
        if n:
            take(arc, 0, shard, n)
        if n < counts[arc]:
            over.append((arc, n))
    for arc, done in over:
        at = arc
        while done < counts[arc]:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            if room[shard]:
                n = min(counts[arc] - done, room[shard])
                take(arc, done, shard, n)
                done += n
    return ranges


def sharded(rows: DataFrame, key: list[str], shards: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with shard and slot (int, long). rows should be narrow; key: columns that tell rows apart."""
    spark = rows.sparkSession
    nodes = ring(shards)
    places = [p for p, _ in nodes]
    arcs = [bisect.bisect_left(places, p) % len(nodes) for p in range(1 << RING_BITS)]
    # a table of 65,536 rows, always
    lookup = F.broadcast(spark.createDataFrame([(p, a) for p, a in enumerate(arcs)], "place int, arc int"))
    h = F.xxhash64(*key)
    parts = max(1, min(4096, -(-rows.count() // (len(nodes) * cell_rows))))
    placed = rows.withColumns(
        {"h": h, "place": F.shiftrightunsigned(h, 64 - RING_BITS).cast("int"), "part": (F.shiftrightunsigned(h, 64 - RING_BITS - 24) % (1 << 24) * parts / (1 << 24)).cast("int")}
    ).join(lookup, "place")
    # arcs times parts: at most 3,072 times as many as keep cells at their size
    cells = placed.groupBy("arc", "part").agg(F.count("*").alias("n")).orderBy("arc", "part").collect()
    counts: dict[int, int] = {}
    firsts = []
    for cell in cells:
        firsts.append((cell["arc"], cell["part"], counts.get(cell["arc"], 0)))
        counts[cell["arc"]] = counts.get(cell["arc"], 0) + cell["n"]
    ranges = place_rows(nodes, counts, shards)
    first = F.broadcast(spark.createDataFrame(firsts, "arc int, part int, first long"))
    to = F.broadcast(spark.createDataFrame(ranges, "arc int, begin long, end long, shard int, slot_of_begin long"))
    order = Window.partitionBy("arc", "part").orderBy("h", *key)
    ranked = placed.withColumn("row", F.row_number().over(order) - 1).join(first, ["arc", "part"]).withColumn("rank", F.col("row") + F.col("first"))
    found = ranked.join(to, "arc").where("rank >= begin and rank < end").withColumn("slot", F.col("slot_of_begin") + F.col("rank") - F.col("begin"))
    return found.select(*rows.columns, "shard", "slot")


def op6_bounded_ring(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = sharded(narrow, ["doc_id", "text_crc32"], SHARDS)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
