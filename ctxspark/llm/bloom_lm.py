"""LM scoring with a log-frequency Bloom filter.

Training texts are counted whole: words, and pairs of neighbours (texts start after a start mark and close with an end mark).
A count c is quantised to q = 1 + floor(log_1.5 c), and the n-gram is put in the filter q times, with the levels 1 to q.
A worker asks for level 1, 2, ... until one is missing; the last found gives the count back. Probabilities interpolate the pair's share
among what follows the word before, and the word's own share:

    P(w | v) = (1 - L) * P(w) + L * c(vw) / c(v),   P(w) = (c(w) + 1) / (N + V + 1).

L depends on the level of c(v). For each level the value of a grid is taken that gives all training texts the largest likelihood when every
token's own occurrence is left out of its counts (one more pass; it sends one row a level and task).

One scan counts both; counts travel packed, by part of the hash space, and meet where the filter's block is built. The filter takes
every n-gram: a block of 64 KB is doubled until it has `BITS_AN_ENTRY` bits for each of its entries. Up to 2^30 bits (128 MB) the filter is broadcast. Beyond that its
blocks stay where they are: texts are dealt in groups, the distinct n-grams of a group travel to the shards of blocks that hold them, and
the levels come back to the group's texts, once for both passes. The answers are those that a broadcast filter gives. The base score needs
exact counts: those of the commonest words are broadcast (at most `HEAD_WORDS`), those of all others are joined.

Defined results: null text counts as empty; an empty text is its end mark; a very long text is scored whole, its words held at once; repeated rows count and come out as often as they
came in; without training rows all counts are zero; an empty table gives an empty result. Other columns are ignored. Words are
compared by XXH64.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm import common
from ctxspark.llm.simhash import LOWER

QUANT = 1.5
#: Weights tried for the pair's share.
GRID = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.96)
HASHES = 4
#: Bits of a block, at least; many entries make blocks larger, not more.
BLOCK_BITS = 19
MAX_LOG_BLOCKS = 11
#: Bits up to which the filter is broadcast.
MAX_LOG_BITS = 30
#: Beyond that: bits of a shard (16 MB) and bytes of a group of texts.
SHARD_LOG_BITS = 27
GROUP_BYTES = 8 << 20
#: Bits a filter entry should have, for about one false answer in a hundred.
BITS_AN_ENTRY = 10
MAX_LOG_PARTS = 16
HEAD_WORDS = 1 << 20
LEVELS = 64
#: Jobs in which the driver fetches the filter.
FETCHES = 16
#: Distinct tokens a task gathers before it hands on its counts.
FLUSH = 2 << 20

END, START = 0xEF46DB3751D8E999, 0x27D4EB2F165667C5
WORD_SALT, LEFT, RIGHT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(words):
    import numpy as np

    return mix(words ^ np.uint64(WORD_SALT))


def pair_keys(before, words):
    import numpy as np

    return mix(before * np.uint64(LEFT) + words * np.uint64(RIGHT))


def tokens(texts: list[bytes]):
    """Hashes of all tokens, end marks included; where each text starts; hashes of the tokens before."""
    import numpy as np
    from xxhash import xxh64_intdigest

    split = [x.translate(LOWER).split() for x in texts]
    n = np.fromiter(map(len, split), np.int64, len(split)) + 1
    stops = np.cumsum(n) - 1
    words = np.empty(int(n.sum()), np.uint64)
    inner = np.ones(len(words), bool)
    inner[stops] = False
    words[inner] = np.fromiter(map(xxh64_intdigest, chain.from_iterable(split)), np.uint64, len(words) - len(split))
    words[stops] = END
    starts = stops - n + 1
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = START
    return words, starts, before


def quantise(counts):
    import numpy as np

    q = 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(QUANT) + 1e-9).astype(np.int64)
    return np.minimum(q, LEVELS)


def level_counts():
    """The count that a level stands for: the mean of the whole numbers it covers."""
    import numpy as np

    edges = QUANT ** np.arange(LEVELS + 1)
    low, high = np.ceil(edges[:-1] - 1e-6), np.ceil(edges[1:] - 1e-6) - 1
    return np.concatenate(([0.0], (low + np.maximum(high, low)) / 2))


def _parts(log_parts: int):
    """Of a key: its part of the hash space, and the 32 bits below."""
    import numpy as np

    def split(keys):
        return (keys >> np.uint64(64 - log_parts)).astype(np.int64), (keys >> np.uint64(32 - log_parts)).astype(np.uint32)

    return split


PACKED = "block int, part int, word boolean, keys binary, counts binary"


def _packed(order_keys, keys, counts, word: bool, log_parts: int, log_blocks: int):
    """One row for each part of the hash space that sorted order_keys fall in: keys (the lower 32 bits, or whole words) and counts."""
    import numpy as np
    import pyarrow as pa

    parts, low = _parts(log_parts)(order_keys)
    keys = np.ascontiguousarray(keys.astype("<u8") if word else low.astype("<u4"))
    starts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
    edges = np.concatenate((starts, [len(parts)]))

    def binary(x, size):
        offsets = (edges * size).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])

    own = parts[starts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array((own >> (log_parts - log_blocks)).astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(np.full(len(own), word)),
            binary(keys, 8 if word else 4), binary(np.minimum(counts, 2**32 - 1).astype("<u4"), 4),
        ],
        names=["block", "part", "word", "keys", "counts"],
    )


def _batches(batches, most: int):
    """Texts of a task, gathered up to about so many bytes."""
    held, size = [], 0
    for batch in batches:
        for x in common.texts(batch.column(0)):
            held.append(x)
            size += len(x)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _merge_counts(pieces):
    import numpy as np

    keys = np.concatenate([k for k, _ in pieces])
    counts = np.concatenate([c for _, c in pieces])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _counter(log_parts: int, log_blocks: int):
    """Distinct words and pairs with counts, of so many texts at a time as have up to FLUSH distinct pairs."""

    def count(batches):
        import numpy as np

        def flush(words, pairs):
            keys, counts = _merge_counts(words)
            place = word_keys(keys)
            order = np.argsort(place)
            yield _packed(place[order], keys[order], counts[order], True, log_parts, log_blocks)
            keys, counts = _merge_counts(pairs)
            yield _packed(keys, keys, counts, False, log_parts, log_blocks)

        words: list = []
        pairs: list = []
        size = 0
        for texts in _batches(batches, 2 * FLUSH):
            own, _, before = tokens(texts)
            words.append(np.unique(own, return_counts=True))
            pairs.append(np.unique(pair_keys(before, own), return_counts=True))
            size += len(pairs[-1][0])
            if size >= FLUSH:
                yield from flush(words, pairs)
                words, pairs, size = [], [], 0
        if pairs:
            yield from flush(words, pairs)

    return count


def _bits(keys, level: int, masks):
    """In-block bit positions of (part << 32 | low) keys at a level, one row for each hash; masks: bits of the keys' blocks, less 1."""
    import numpy as np

    mixed = mix(keys + np.uint64((level * 0xD6E8FEB86659FD93) % 2**64))
    a, b = mixed >> np.uint64(32), (mixed >> np.uint64(8)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & masks).astype(np.int64) for i in range(HASHES)]


BUILT = "word boolean, block int, a binary, b binary"


def _block_builder(log_parts: int):
    """Rows sorted by block and part. A part's counts are summed, its words handed on, and all its n-grams enter the block."""

    def build(batches):
        import numpy as np
        import pyarrow as pa

        block = part = None
        pieces: dict = {True: [], False: []}
        entries: list = []  # (keys, levels) of the block

        def row(word, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array([word]), pa.array([block], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["word", "block", "a", "b"]
            )

        def close_part():
            for word in (True, False):
                if not pieces[word]:
                    continue
                keys, counts = _merge_counts(pieces[word])
                if word:
                    yield row(True, keys.astype("<u8").tobytes(), counts.astype("<i8").tobytes())
                    low = _parts(log_parts)(word_keys(keys.astype(np.uint64)))[1]
                else:
                    low = keys
                entries.append((low.astype(np.uint64) | np.uint64(part << 32), quantise(counts)))
                pieces[word] = []

        def close_block():
            yield from close_part()
            keys, levels = (np.concatenate(x) for x in zip(*entries))
            size = 1 << max(BLOCK_BITS, (BITS_AN_ENTRY * int(levels.sum()) - 1).bit_length())
            bits = np.zeros(size, bool)
            for level in range(1, int(levels.max(initial=0)) + 1):
                for at in _bits(keys[levels >= level], level, np.uint64(size - 1)):
                    bits[at] = True
            entries.clear()
            yield row(False, np.packbits(bits, bitorder="little").tobytes(), b"")

        for batch in batches:
            for b, p, word, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("block", "part", "word", "keys", "counts"))):
                if p != part:
                    if b != block and block is not None:
                        yield from close_block()
                    elif part is not None:
                        yield from close_part()
                    block, part = b, p
                own = pieces[word]
                own.append((np.frombuffer(keys, "<u8" if word else "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)))
                if len(own) >= 4096:
                    own[:] = [_merge_counts(own)]
        if block is not None:
            yield from close_block()

    return build


def _unpack_words(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), pa.array(np.frombuffer(b, "<i8"))], names=["h", "n"])


class Filter:
    """The filter, or a shard of it: bits of the blocks from `first` on, whose bytes are given."""

    def __init__(self, log_blocks: int, log_parts: int, lengths, first: int = 0) -> None:
        import numpy as np

        self.log_blocks, self.log_parts, self.first = log_blocks, log_parts, first
        lengths = np.maximum(lengths, 8)  # a block without entries is empty, but there
        self.masks = (8 * lengths - 1).astype(np.uint64)
        self.starts = np.cumsum(lengths) - lengths
        self.even = bool((lengths == lengths[0]).all())
        self.bits = np.zeros(int(lengths.sum()), np.uint8)

    def put(self, block: int, data: bytes) -> None:
        import numpy as np

        at = int(self.starts[block - self.first])
        self.bits[at : at + len(data)] = np.frombuffer(data, np.uint8)

    def levels(self, keys):
        """Level of each key, by asking for one after the other; 0: not there."""
        import numpy as np

        levels = np.zeros(len(keys), np.int64)
        block = (keys >> np.uint64(64 - self.log_blocks)).astype(np.int64) - self.first
        parts, low = _parts(self.log_parts)(keys)
        own = (parts.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
        alive = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            held, of = np.ones(len(alive), bool), block[alive]
            start = self.starts[of]
            for at in _bits(own[alive], level, self.masks[0] if self.even else self.masks[of]):
                held &= (self.bits[start + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[held]
            if not len(alive):
                break
            levels[alive] = level
        return levels


class Model:
    """What workers get: the filter (None beyond the broadcast bound), corpus totals, and the commonest words' exact counts."""

    def __init__(self, filter_: Filter | None, total: int, distinct: int, head, head_counts) -> None:
        self.filter, self.total, self.distinct = filter_, total, distinct
        self.head, self.head_counts = head, head_counts
        self.weights = None
        #: Only on the driver, and only without a filter: what asks its blocks.
        self.shards: Shards | None = None

    def base_logs(self, counts):
        import numpy as np

        return np.log10((counts + 1) / (self.total + (self.distinct + 1)))

    def exact(self, kinds):
        """Counts of words (sorted keys) in the head, -1 elsewhere."""
        import numpy as np

        if not len(self.head):
            return np.full(len(kinds), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head, kinds), len(self.head) - 1)
        return np.where(self.head[at] == kinds, self.head_counts[at], -1)

    def shares(self, words, before, kinds, back, told=None, own: int = 0):
        """Per token, from the filter alone: P(word), the pair's share after the word before, and the level of the word before.

        kinds, back: the distinct words' keys, sorted, and where each token's is; told: the tokens' levels and their pairs', where shards
        have been asked; own: occurrences to leave out of the counts. Sorted keys go through the filter block by block.
        """
        import numpy as np

        table = level_counts()
        if told is None:
            single = self.filter.levels(kinds)
            own_level = single[back]
            pairs, back_pairs = np.unique(pair_keys(before, words), return_inverse=True)
            together = table[self.filter.levels(pairs)][back_pairs]
        else:
            own_level, pairs = told
            single = np.zeros(len(kinds), np.int64)
            single[back] = own_level
            together = table[pairs]
        share = (np.maximum(table[single] - own, 0) + 1)[back] / (self.total + self.distinct + 1 - own)
        level = np.empty_like(own_level)
        level[1:] = own_level[:-1]
        # texts start as often as they end
        level[before == np.uint64(START)] = int(single[kinds == word_keys(np.array([END], np.uint64))].max(initial=0))
        left = table[level] - own
        pair = np.where(left > 0, np.clip((together - own) / np.maximum(left, 1), 0, 1), 0.0)
        return share, pair, level

    def log_probabilities(self, words, before, kinds, back, told=None):
        """log10 P(word | word before)."""
        import numpy as np

        share, pair, level = self.shares(words, before, kinds, back, told)
        weight = self.weights[level]
        return np.log10((1 - weight) * share + weight * pair)


def _groups(texts: list[bytes], levels: list | None = None, most: int = 4 << 20):
    """Texts in groups of about so many bytes, with what shards told of their tokens."""
    begin, size = 0, 0
    for end, x in enumerate(texts):
        if end > begin and size + len(x) > most:
            yield texts[begin:end], _told(levels, begin, end)
            begin, size = end, 0
        size += len(x)
    if texts:
        yield texts[begin:], _told(levels, begin, len(texts))


def _told(levels: list | None, begin: int, end: int):
    """Levels of the tokens and of their pairs; a text's come as one byte for each, first all tokens', then all pairs'."""
    import numpy as np

    if levels is None:
        return None
    rows = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in levels[begin:end]]
    return np.concatenate(rows, axis=1).astype(np.int64)


def _asked(words, before):
    """A group's distinct keys, sorted."""
    import numpy as np

    return np.unique(np.concatenate((word_keys(words), pair_keys(before, words))))


def _grouper(at: int):
    """Rows with the number of their group; the rows of a group follow one another."""

    def group(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = done + np.cumsum(np.fromiter(map(len, common.texts(batch.column(at))), np.int64, batch.num_rows))
            group = first + np.concatenate(([done], ends[:-1]))[: len(ends)] // GROUP_BYTES
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int64))], names=[*batch.schema.names, "group"])

    return group


def _runs(batches):
    """Tables of rows with the same group, over batch borders too."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        groups = batch.column(batch.schema.get_field_index("group")).to_numpy()
        edges = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *edges], [*edges, len(groups)]):
            if a == b:
                continue
            if held and held[-1][0] != groups[a]:
                yield held[0][0], pa.Table.from_batches([x for _, x in held])
                held = []
            held.append((groups[a], batch.slice(a, b - a)))
    if held:
        yield held[0][0], pa.Table.from_batches([x for _, x in held])


PROBES = "shard int, block int, group long, data binary"


def _prober(log_shards: int):
    """A group's keys, one row for each shard."""

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        for group, rows in _runs(batches):
            words, _, before = tokens(common.texts(rows.column("text").combine_chunks()))
            keys = _asked(words, before)
            shards = (keys >> np.uint64(64 - log_shards)).astype(np.int32)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(keys)]
            n = len(edges) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shards[edges[:-1]]), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, group, np.int64)),
                    pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                ],
                names=["shard", "block", "group", "data"],
            )

    return probe


def _answerer(log_blocks: int, log_parts: int, log_shards: int):
    """Rows sorted by shard, its blocks before its probes: the probes' levels."""

    def answer(batches):
        import numpy as np
        import pyarrow as pa

        own, shard, blocks = None, None, {}
        for batch in batches:
            found: list = [[], [], []]
            for s, block, group, data in zip(*(batch.column(n).to_pylist() for n in ("shard", "block", "group", "data"))):
                if s != shard:
                    own, shard, blocks = None, s, {}
                if group is None:
                    blocks[block] = data
                    continue
                if own is None:
                    first, n = s << (log_blocks - log_shards), 1 << (log_blocks - log_shards)
                    own = Filter(log_blocks, log_parts, np.array([len(blocks.get(first + i, b"")) for i in range(n)]), first)
                    while blocks:
                        own.put(*blocks.popitem())
                levels = own.levels(np.frombuffer(data, "<u8").astype(np.uint64))
                for column, x in zip(found, (group, s, levels.astype(np.uint8).tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.binary())], names=["group", "shard", "levels"]
            )

    return answer


def _teller(names: list[str]):
    """Rows sorted by group, its answers in the order of the shards before its texts: the texts with their tokens' levels."""

    def tell(batches):
        import numpy as np
        import pyarrow as pa

        for _, rows in _runs(batches):
            answers = rows.column("levels").combine_chunks().drop_null()
            own = rows.slice(len(answers))
            found = np.frombuffer(b"".join(answers.to_pylist()), np.uint8)
            words, starts, before = tokens(common.texts(own.column("text").combine_chunks()))
            keys = _asked(words, before)
            single, pair = (found[np.searchsorted(keys, k)] for k in (word_keys(words), pair_keys(before, words)))
            edges = [*starts, len(words)]
            levels = pa.array([single[a:b].tobytes() + pair[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            for batch in own.select(names).append_column("levels", levels).combine_chunks().to_batches():
                yield batch

    return tell


class Shards:
    """The blocks of a filter over the broadcast bound, as a DataFrame."""

    def __init__(self, blocks: DataFrame, log_blocks: int, log_parts: int, bits: int) -> None:
        self.blocks, self.log_blocks, self.log_parts = blocks, log_blocks, log_parts
        self.log_shards = max(0, min(log_blocks, bits.bit_length() - SHARD_LOG_BITS))

    def tell(self, rows: DataFrame) -> DataFrame:
        """rows (text, ...) with the levels of all tokens and pairs."""
        fields = [*rows.schema.fields, T.StructField("group", T.LongType())]
        # groups must be the same when their answers come
        grouped = common.cut(rows.mapInArrow(_grouper(rows.columns.index("text")), T.StructType(fields)))
        probes = grouped.select("text", "group").mapInArrow(common.tidy(_prober(self.log_shards)), PROBES)
        shard = F.shiftright("block", self.log_blocks - self.log_shards)
        held = self.blocks.select(shard.alias("shard"), "block", F.lit(None).cast("long").alias("group"), F.col("a").alias("data"))
        met = held.union(probes).repartition("shard").sortWithinPartitions("shard", F.col("group").asc_nulls_first())
        answers = met.mapInArrow(common.tidy(_answerer(self.log_blocks, self.log_parts, self.log_shards)), "group long, shard int, levels binary")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        both = answers.select("group", "shard", "levels", *empty).union(
            grouped.select("group", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("levels"), *rows.columns)
        )
        dealt = both.repartition("group").sortWithinPartitions("group", F.col("shard").asc_nulls_last())
        told = T.StructType([*rows.schema.fields, T.StructField("levels", T.BinaryType())])
        return common.cut(dealt.mapInArrow(common.tidy(_teller(rows.columns)), told))


def _weigher(model):
    """Log-likelihoods of all weights tried, summed by level."""

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((LEVELS + 1, len(GRID)))
        for batch in batches:
            levels = batch.column(1).to_pylist() if batch.num_columns > 1 else None
            for group, told in _groups(common.texts(batch.column(0)), levels):
                words, _, before = tokens(group)
                kinds, back = np.unique(word_keys(words), return_inverse=True)
                share, pair, level = model.value.shares(words, before, kinds, back, told, own=1)
                for i, weight in enumerate(GRID):
                    sums[:, i] += np.bincount(level, np.log10((1 - weight) * share + weight * pair), LEVELS + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(LEVELS + 1)), *(pa.array(sums[:, i]) for i in range(len(GRID)))], names=["level", *(f"g{i}" for i in range(len(GRID)))]
        )

    return weigh


def _weights(corpus: DataFrame, model):
    """The best weight for each level of the word before."""
    import numpy as np

    names = [f"g{i}" for i in range(len(GRID))]
    told = corpus.mapInArrow(common.tidy(_weigher(model)), "level long, " + ", ".join(f"{n} double" for n in names))
    weights = np.zeros(LEVELS + 1)
    for row in told.groupBy("level").agg(*[F.sum(n).alias(n) for n in names]).collect():  # LEVELS rows
        weights[row["level"]] = GRID[int(np.argmax([row[n] for n in names]))]
    return weights


SCORES = common.struct("n_tokens long, head_known long, head_base double, score double, rare binary, times binary")


def _scorer(model, sharded: bool):
    def score(text, levels=None):
        import numpy as np
        import pyarrow as pa

        out: list = [[], [], [], []]
        rare: list = [[], []]
        for group, told in _groups(common.texts(text), None if levels is None else levels.to_pylist()):
            words, starts, before = tokens(group)
            kinds, back = np.unique(word_keys(words), return_inverse=True)
            known = model.value.exact(kinds)
            counts, base = known[back], np.where(known >= 0, model.value.base_logs(np.maximum(known, 0)), 0.0)[back]
            n = np.diff(np.concatenate((starts, [len(words)])))
            out[0].append(n)
            out[1].append(np.add.reduceat((counts > 0).astype(np.int64), starts))
            out[2].append(np.add.reduceat(base, starts))
            out[3].append(np.add.reduceat(model.value.log_probabilities(words, before, kinds, back, told), starts))
            # words outside the head, with their times in the text
            outside = np.flatnonzero(counts < 0)
            word, of = words[outside], np.repeat(np.arange(len(group)), n)[outside]
            order = np.lexsort((word, of))
            word, of = word[order], of[order]
            new = np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))[: len(word)]
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate((first, [len(word)])))
            edges = np.searchsorted(of[first], np.arange(len(group) + 1))
            for k, x in enumerate((word[first].astype("<u8"), times.astype("<u4"))):
                rare[k] += [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        kinds = (np.int64, np.int64, np.float64, np.float64)
        columns = [pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for c, k in zip(out, kinds)]
        return pa.StructArray.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in rare)], names=SCORES.names)

    if sharded:
        return F.arrow_udf(lambda text, levels: score(text, levels), SCORES)
    return F.arrow_udf(lambda text: score(text), SCORES)


def _unpack_rare(batches):
    """Words outside the head: key and length of the text, word, times, and how many such words the text has."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("key", "size", "rare", "times")))
        kept = [(k, z, np.frombuffer(h, "<i8"), np.frombuffer(t, "<u4")) for k, z, h, t in rows if h]
        if kept:
            n = [len(x[2]) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([x[0] for x in kept], n)), pa.array(np.repeat([x[1] for x in kept], n).astype(np.int32)),
                    pa.array(np.concatenate([x[2] for x in kept])), pa.array(np.concatenate([x[3] for x in kept]).astype(np.int32)),
                    pa.array(np.repeat(n, n).astype(np.int32)),
                ],
                names=["key", "size", "h", "times", "kinds"],
            )


def train(corpus: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """corpus (text) -> the model without weights, and the exact counts (h, n) of words outside the head."""
    import numpy as np

    common.bounded_batches(corpus.sparkSession)
    size = corpus.agg(F.sum(F.octet_length("text").cast("double") + 6)).first()[0] or 0.0
    expected = size / 6  # tokens; decides on sizes only
    log_blocks = max(0, min(MAX_LOG_BLOCKS, int(BITS_AN_ENTRY * expected + 1).bit_length() - BLOCK_BITS))
    log_parts = max(log_blocks, min(MAX_LOG_PARTS, (int(expected) >> 16).bit_length()))
    packed = corpus.mapInArrow(common.tidy(_counter(log_parts, log_blocks)), PACKED)
    dealt = packed.repartition("block").sortWithinPartitions("block", "part")
    built = common.cut(dealt.mapInArrow(common.tidy(_block_builder(log_parts)), BUILT))
    blocks, filter_, shards = built.where("not word").select("block", "a"), None, None
    lengths = np.zeros(1 << log_blocks, np.int64)
    for row in blocks.select("block", F.octet_length("a").alias("n")).collect():  # 2,048 rows at most
        lengths[row["block"]] = row["n"]
    bits = 8 * int(lengths.sum())
    if bits > 1 << MAX_LOG_BITS:
        shards = Shards(blocks, log_blocks, log_parts, bits)
    else:
        filter_ = Filter(log_blocks, log_parts, lengths)
        for row in blocks.coalesce(FETCHES).toLocalIterator():
            filter_.put(row["block"], bytes(row["a"]))
    counts = built.where("word").select("a", "b").mapInArrow(_unpack_words, "h long, n long")
    # how many words are how common, in eighths of a power of two: a few hundred rows
    bins = (
        counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("total"), F.min("n").alias("least"))
        .orderBy(F.desc("bin")).collect()
    )
    least, room = 2**62, head_words
    for row in bins:
        room -= row["words"]
        if room < 0:
            break
        least = row["least"]
    head = counts.where(F.col("n") >= least).toArrow()
    words = word_keys(head.column("h").to_numpy().view(np.uint64))
    order = np.argsort(words)
    model = Model(
        filter_, sum(r["total"] for r in bins), sum(r["words"] for r in bins),
        words[order], head.column("n").to_numpy()[order].astype(np.int64),
    )
    model.shards = shards
    return model, counts.where(F.col("n") < least)


def scored(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; `training` is a condition on docs."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), training.alias("training"))
    corpus = own.where("training").select("text")
    model, tail = train(corpus)
    shards, model.shards = model.shards, None  # DataFrames stay on the driver
    if shards is not None:
        own = shards.tell(own)
        corpus = own.where("training").select("text", "levels")
    asked = ["text"] if shards is None else ["text", "levels"]
    model.weights = _weights(corpus, spark.sparkContext.broadcast(model))
    model_b = spark.sparkContext.broadcast(model)
    keyed = own.withColumns({"key": F.xxhash64("text"), "size": F.octet_length("text").cast("int")})
    scores = common.cut(keyed.withColumn("s", _scorer(model_b, shards is not None)(*asked)).select("doc_id", "training", "key", "size", "s.*"))
    rare = scores.select("key", "size", "rare", "times").mapInArrow(_unpack_rare, "key long, size int, h long, times int, kinds int")
    counted = rare.join(tail.select(F.col("h").alias("w"), F.col("n")), F.col("h") == F.col("w"), "left")
    log = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.total + model.distinct + 1)))
    # equal texts each send their rare words; kinds tells how often
    rest = counted.groupBy("key", "size").agg(
        (F.count("*") / F.max("kinds")).alias("copies"), F.sum(log).alias("base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known")
    )
    rest = rest.select(
        F.col("key").bitwiseXOR(F.lit(1)).alias("k"), F.col("size").alias("z"),
        (F.col("base") / F.col("copies")).alias("base"), F.round(F.col("known") / F.col("copies")).cast("long").alias("known"),
    )
    joined = scores.join(rest, (F.col("key").bitwiseXOR(F.lit(1)) == F.col("k")) & (F.col("size") == F.col("z")), "left")
    return joined.select(
        "doc_id", "training", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score",
    )


def op9_bloom_lm(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scored(docs, common.fold("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
