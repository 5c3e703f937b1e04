"""Substring dedup: remove every word covered by a 35-word window that also starts elsewhere.

1. Each window is represented by its anchor, the least 16-word gram in it (leftmost of equals). Equal windows
   have equal anchors, so an anchor occurs at least as often as any window that has it: its count overestimates.
   Partitions count anchors in count-min sketches with counters that stop at two; the merged sketch tells which
   windows may be repeated. Adjacent windows share anchors, so there are some ten times fewer than windows.
2. Exact pass. Consecutive windows of one anchor are a run. Runs that the sketch lets through are grouped exactly,
   first as whole spans: a span found twice has only repeated windows. Where several different spans share an
   anchor, their single windows are grouped exactly as well. Nothing that is repeated is lost; what the sketch
   lets through needlessly is thrown out here.
3. Repeated spans and windows are located in the texts, and joined to them by the texts' digests.

Spans are compared by two independent 64-bit polynomial hashes of 128-bit word digests. Sketch and filters have a
fixed largest size (`MAX_LOG_CELLS`); beyond it they let more through and the exact pass does more. Groups are
only counted, with partial sums, and joins are on keys that adaptive execution may split, so a hot passage or
thousands of copies don't meet in one task.

Defined results: bytes that are no UTF-8 are parts of words like others; very long texts are scanned in overlapping pieces, and held once more
as words when they are cut; null text counts as empty; texts of fewer words than a window are kept; a row repeated with its
text counts as another place, so both lose their words; rows come out as often as they came in; an empty table gives
an empty result. Columns other than the text are passed through or ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import common

WINDOW = 35
GRAM = 16
#: Odd multipliers of the two polynomials and of the sketch's rows.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SKETCH_ROWS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
#: 2^29 cells in each of two rows: 128 MB as bits, the bound of what is broadcast.
MAX_LOG_CELLS = 29
#: Jobs in which the driver fetches the merged sketch.
FETCHES = 16
POSITION_BITS = 28
M64 = 2**64 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Longer texts are scanned in overlapping pieces.
PIECE_BYTES = 4 << 20


class Bitmap:
    """Which cells of the merged sketch reached the threshold; read-only on workers."""

    def __init__(self, log_cells: int, bits) -> None:
        self.log_cells, self.bits = log_cells, bits

    def may_hold(self, keys):
        import numpy as np

        found = np.ones(len(keys), bool)
        for row, odd in enumerate(SKETCH_ROWS):
            cell = (keys * np.uint64(odd)) >> np.uint64(64 - self.log_cells)
            found &= (self.bits[row][(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def log_cells(keys: float, threshold: int = 1) -> int:
    """Eight to sixteen cells a key where one key is enough, half of it where two must meet, within the bound."""
    return max(16, min(MAX_LOG_CELLS, int(8 * keys / threshold + 1).bit_length()))


def _emit_cells(keys, log: int):
    """The partition's sketch, sparse: a row for each block of 2^16 cells, a cell listed twice if counted twice or more."""
    import numpy as np
    import pyarrow as pa

    for row, odd in enumerate(SKETCH_ROWS):
        cells = np.sort((keys * np.uint64(odd)) >> np.uint64(64 - log))
        third = np.zeros(len(cells), bool)
        third[2:] = cells[2:] == cells[:-2]
        cells = cells[~third]
        blocks = (cells >> np.uint64(16)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        offsets = np.concatenate((starts, [len(cells)])).astype(np.int32) * 2
        low = np.ascontiguousarray((cells & np.uint64(0xFFFF)).astype("<u2"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks[starts] + (row << (log - 16)), pa.int32()),
                pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())]),
            ],
            names=["block", "cells"],
        )


def _cell_writer(log: int, keys_of, most: int = 1 << 21):
    def write(batches):
        import numpy as np

        held, n = [], 0
        for batch in batches:
            keys = keys_of(batch)
            held.append(keys)
            n += len(keys)
            if n >= most:
                yield from _emit_cells(np.concatenate(held), log)
                held, n = [], 0
        if n:
            yield from _emit_cells(np.concatenate(held), log)

    return write


def _merger(threshold: int):
    def merge(batches):
        """Rows sorted by block; one block is held at a time."""
        import numpy as np
        import pyarrow as pa

        at, held, n, counts = None, [], 0, None

        def add():
            nonlocal held, n, counts
            if held:
                found = np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=1 << 16)
                counts = np.minimum(found, 2) if counts is None else np.minimum(counts + found, 2)
            held, n = [], 0

        def done():
            add()
            bits = np.packbits(counts >= threshold, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                if block != at:
                    if at is not None:
                        yield done()
                    at, counts = block, None
                held.append(cells)
                n += len(cells)
                if n > 1 << 22:
                    add()
        if at is not None:
            yield done()

    return merge


def _bitmap(rows: DataFrame, keys_of, keys: float, threshold: int) -> Bitmap:
    """Sketch the partitions, merge block by block, and bring the bits (of bounded size) to the driver."""
    import numpy as np

    log = log_cells(keys, threshold)
    parts = rows.mapInArrow(common.tidy(_cell_writer(log, keys_of)), "block int, cells binary")
    # merged by all tasks at once, then fetched partition by partition
    merged = common.cut(parts.repartition("block").sortWithinPartitions("block").mapInArrow(common.tidy(_merger(threshold)), "block int, bits binary"))
    bits = [np.zeros(1 << (log - 3), np.uint8) for _ in SKETCH_ROWS]
    blocks = 1 << (log - 16)
    for found in merged.coalesce(FETCHES).toLocalIterator():
        row, block = divmod(found["block"], blocks)
        bits[row][block << 13 : (block + 1) << 13] = np.frombuffer(bytes(found["bits"]), np.uint8)
    return Bitmap(log, bits)


_POWERS: dict = {}


def _powers(n: int):
    """B^i and B^-i for both polynomials, kept for the longest batch so far."""
    import numpy as np

    if _POWERS.get("n", 0) < n:
        n = max(n, 1 << 16)
        _POWERS["up"] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in BASES]
        _POWERS["down"] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, pow(b, -1, 2**64), np.uint64)))) for b in BASES]
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


class Runs:
    """Windows of a group of pieces of texts, in runs of one anchor each."""

    def __init__(self, group: list[tuple[int, int, bytes]]) -> None:
        import numpy as np
        from xxhash import xxh3_128_digest

        split = [x.split() for _, _, x in group]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        n = int(lengths.sum())
        if n >= 1 << POSITION_BITS:
            raise ValueError("too many words in one group of pieces")
        self.first = np.cumsum(lengths) - lengths
        ends = self.first + lengths - WINDOW + 1  # window starts of text t: first[t] .. ends[t] - 1
        self.anchor = np.zeros(0, np.uint64)
        self.start = self.stop = self.text = np.zeros(0, np.int64)
        if n < WINDOW or not (lengths >= WINDOW).any():
            return
        digests = np.frombuffer(b"".join(map(xxh3_128_digest, chain.from_iterable(split))), "<u8").reshape(n, 2)
        up, down = _powers(n + 1)
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(digests[:, k] * up[k][:n]))) for k in (0, 1)]
        self.down = down
        gram = (self.sums[0][GRAM:] - self.sums[0][:-GRAM]) * down[0][: n - GRAM + 1]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(32)
        least = (gram >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(gram), dtype=np.uint64)
        width, have = WINDOW - GRAM + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        where = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        text_of = np.repeat(np.arange(len(split)), np.maximum(lengths, 0))[: len(where)]
        windows = np.flatnonzero(np.arange(len(where)) < ends[text_of])
        at = where[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        begins = np.flatnonzero(new)
        self.start = windows[begins]
        self.stop = windows[np.concatenate((begins[1:], [len(windows)])) - 1] if len(begins) else self.start
        self.anchor = gram[at[begins]]
        self.text = text_of[self.start]

    def pick(self, which) -> None:
        self.anchor, self.start, self.stop, self.text = self.anchor[which], self.start[which], self.stop[which], self.text[which]

    def keys(self, start, stop):
        """Two hashes of the words from window start to the end of window stop."""
        return [(s[stop + WINDOW] - s[start]) * d[start] for s, d in zip(self.sums, self.down)] if len(start) else [start.astype("u8")] * 2

    def windows(self):
        """Run number and start of each of the runs' windows."""
        import numpy as np

        n = self.stop - self.start + 1
        run = np.repeat(np.arange(len(n)), n)
        return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + self.start[run]


def pieces(text: bytes, most: int | None = None):
    """(words before, piece) so that each window starts in one piece and ends in it: a piece holds the next one's first words as well."""
    most = PIECE_BYTES if most is None else most
    at = words = 0
    while True:
        space = SPACE.search(text, at + most) if at + most < len(text) else None
        if space is None:
            yield words, text[at:]
            return
        cut = space.start()
        more = list(islice(WORD.finditer(text, cut), WINDOW - 1))
        yield words, text[at : more[-1].end() if more else cut]
        words += len(text[at:cut].split())
        at = cut


def _groups(texts: list[bytes], most: int = 2 << 20):
    """(text's place in the batch, words before, piece) of the texts, a few MB at a time."""
    held, size = [], 0
    for i, x in enumerate(texts):
        for words, piece in pieces(x):
            if held and size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((i, words, piece))
            size += len(piece)
    if held:
        yield held


def _signed(x):
    import numpy as np

    return x.view(np.int64)


def _anchors(batch):
    import numpy as np

    return np.concatenate([np.zeros(0, np.uint64), *(Runs(g).anchor for g in _groups(common.texts(batch.column(0))))])


def _key_column(batch):
    import numpy as np

    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _counted(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(_signed(c), pa.int64()) for c in columns], names=names)


def _span_scan(maybe):
    def scan(batches):
        for batch in batches:
            for group in _groups(common.texts(batch.column(0))):
                runs = Runs(group)
                runs.pick(maybe.value.may_hold(runs.anchor))
                if len(runs.start):
                    yield _counted([runs.anchor, *runs.keys(runs.start, runs.stop)], ["g", "a", "b"])

    return scan


def _window_scan(maybe, shared):
    """Windows of the runs whose anchor several different spans have."""

    def scan(batches):
        for batch in batches:
            for group in _groups(common.texts(batch.column(0))):
                runs = Runs(group)
                runs.pick(maybe.value.may_hold(runs.anchor))
                runs.pick(shared.value.may_hold(runs.keys(runs.start, runs.stop)[0]))
                if len(runs.start):
                    _, at = runs.windows()
                    yield _counted(runs.keys(at, at), ["a", "b"])

    return scan


def _place_scan(maybe, single, repeated, most_seen: int = 200_000):
    """Where repeated spans are, and repeated windows of spans found once; equal texts of a task speak once."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        for batch in batches:
            names, fresh = [], []
            for x in common.texts(batch.column(0)):
                key = hashlib.md5(x).digest()
                if key not in seen:
                    if len(seen) >= most_seen:
                        seen.clear()
                    seen.add(key)
                    names.append(key)
                    fresh.append(x)
            for group in _groups(fresh):
                runs = Runs(group)
                before = np.array([words for _, words, _ in group])
                runs.pick(maybe.value.may_hold(runs.anchor))
                if not len(runs.start):
                    continue
                keys = runs.keys(runs.start, runs.stop)
                whole = repeated.value.may_hold(keys[0])
                start, stop, text, a, b = (x[whole] for x in (runs.start, runs.stop, runs.text, *keys))
                runs.pick(single.value.may_hold(keys[0]))
                if len(runs.start):
                    run, at = runs.windows()
                    keys = runs.keys(at, at)
                    some = repeated.value.may_hold(keys[0])
                    start, stop = (np.concatenate((x, at[some])) for x in (start, stop))
                    text = np.concatenate((text, runs.text[run][some]))
                    a, b = (np.concatenate((x, y[some])) for x, y in zip((a, b), keys))
                if len(start):
                    shift = before[text] - runs.first[text]
                    place = ((start + shift) << 32) | (stop + shift + WINDOW)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(a), pa.int64()), pa.array(_signed(b), pa.int64()), pa.array([names[group[i][0]] for i in text], pa.binary()), pa.array(place, pa.int64())],
                        names=["a", "b", "t", "place"],
                    )

    return scan


def repeated_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each text digest `t` (binary MD5) with repeated windows: `places`, longs of first word << 32 | end word."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    sc = spark.sparkContext
    corpus = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    size = corpus.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    maybe = sc.broadcast(_bitmap(corpus, _anchors, size / 50, 2))

    spans = corpus.mapInArrow(common.tidy(_span_scan(maybe)), "g long, a long, b long").groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    spans = common.cut(spans)
    shared = spans.groupBy("g").agg(F.count("*").alias("spans")).where("spans > 1")
    known = common.cut(
        spans.join(shared.select(F.col("g").bitwiseXOR(F.lit(1)).alias("h")), F.col("g").bitwiseXOR(F.lit(1)) == F.col("h"), "left")
        .select("a", "b", (F.col("n") > 1).alias("many"), F.col("h").isNotNull().alias("shared"))
        .where("many or shared")
    )
    sizes = known.agg(
        F.count_if("shared").alias("shared"), F.count_if(F.expr("shared and not many")).alias("single"), F.count_if("many").alias("many")
    ).first()
    of_shared = sc.broadcast(_bitmap(known.where("shared").select("a"), _key_column, sizes["shared"], 1))
    windows = common.cut(
        corpus.mapInArrow(common.tidy(_window_scan(maybe, of_shared)), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    )
    repeated = known.where("many").select("a", "b").union(windows)
    single = sc.broadcast(_bitmap(known.where("shared and not many").select("a"), _key_column, sizes["single"], 1))
    of_repeated = sc.broadcast(_bitmap(repeated.select("a"), _key_column, sizes["many"] + windows.count(), 1))
    places = corpus.mapInArrow(common.tidy(_place_scan(maybe, single, of_repeated)), "a long, b long, t binary, place long")
    exact = repeated.distinct().select(F.col("a").bitwiseXOR(F.lit(1)).alias("x"), F.col("b").alias("y"))
    found = common.cut(
        places.join(exact, (F.col("a").bitwiseXOR(F.lit(1)) == F.col("x")) & (F.col("b") == F.col("y")), "left_semi")
        .groupBy("t")
        .agg(F.collect_set("place").alias("places"))
    )
    # what workers hold goes before the texts are joined and cut
    for held in (maybe, of_shared, single, of_repeated):
        held.destroy()
    return found


CUT = common.struct("n_words long, n_removed long, kept binary, kept_sha256 string")


@F.arrow_udf(CUT)
def _cut_words(text, places):
    import numpy as np
    import pyarrow as pa

    n_words, n_removed, kept, digests = [], [], [], []
    for x, found in zip(common.texts(text), places.to_pylist()):
        words = x.split()
        if found:
            gone = np.zeros(len(words) + 1, np.int64)
            for place in found:
                gone[place >> 32] += 1
                gone[place & 0xFFFFFFFF] -= 1
            left = np.cumsum(gone[:-1]) == 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], left, [False]))))
            at = [m.span() for m in WORD.finditer(x)]
            spans = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
            n_removed.append(len(words) - int(left.sum()))
            kept.append(b" ".join(x[at[a][0] : at[b - 1][1]] for a, b in spans))
            words = list(chain.from_iterable(words[a:b] for a, b in spans))
            n_words.append(len(left))
        else:
            n_words.append(len(words))
            n_removed.append(0)
            kept.append(x)
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    common.release()
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
        names=["n_words", "n_removed", "kept", "kept_sha256"],
    )


def with_removed(docs: DataFrame, out: str = "cut", text: str = "text") -> DataFrame:
    """docs with a struct: n_words, n_removed, kept (UTF-8 of the text without the removed words; untouched texts stay as
    they are) and kept_sha256 (of the kept words joined by one space)."""
    places = repeated_places(docs, text)
    key = f"__{out}_key"
    left = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    right = places.select(F.concat("t", F.lit(b"")).alias(f"{key}_"), F.col("places").alias(f"{key}_places"))
    joined = left.join(right, F.col(key) == F.col(f"{key}_"), "left")
    return joined.withColumn(out, _cut_words(F.col(text).cast("string"), F.col(f"{key}_places"))).drop(key, f"{key}_", f"{key}_places")


def op2_substring_cms(spark, sf_dir: str) -> DataFrame:
    found = with_removed(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "cut")
    return found.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


OP2_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + j AS p FROM rep, (SELECT unnest(range({WINDOW})) AS j)),
each AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
