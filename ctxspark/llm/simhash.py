"""SimHash near-dedup: fingerprints, and BK-trees that find all pairs within a Hamming radius.

Finding all pairs. A fingerprint's 64 bits are cut into `radius + 1` blocks; two fingerprints that differ
in at most `radius` bits agree on one block at least. Fingerprints that share a block's value form a shard.
In the task that holds it, a shard becomes a BK-tree (children keyed by their Hamming distance to the
parent) and each member follows only the edges within the radius. A tree goes only to the tasks whose
queries can meet it, so what is sent is in proportion to the fingerprints; sending every tree to every worker
would have no size bound. A shard over `SHARD_ROWS` is cut again, by the remaining bits, in the same lossless
way, until its trees are small; only equal fingerprints can't be cut, and those are merged beforehand.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like others;
a very long text is hashed whole, with eight bytes a shingle and its words held at once;
repeated rows come out as often as they came in; a null doc_id gets its group's least id (null if none);
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm import common

SEED = 42
#: Rows of a shard from which it is cut by further bits.
SHARD_ROWS = 4096
#: Radius up to which a BK-tree's edges leave out enough of it.
TREE_RADIUS = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int = 4):
    """XXH64 of each shingle of lower-cased words, repeats included; fewer words than a shingle: the whole sequence; no words: none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint_of(hashes) -> int:
    """A bit is set if it is set in over half the hashes; none: 0."""
    import numpy as np

    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text in parts: 4 MB of bits at a time
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def _fingerprints(text):
    import numpy as np
    import pyarrow as pa

    found = [fingerprint(x) for x in common.texts(text)]
    common.release()
    return pa.array(np.array(found, np.uint64).view(np.int64))


# else a join's filter for nulls would be pushed below the call and run it once more
_fingerprints = F.arrow_udf(_fingerprints, T.LongType()).asNondeterministic()


def with_fingerprint(docs: DataFrame, out: str = "fp", text: str = "text") -> DataFrame:
    """docs and its fingerprints as signed longs."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text).cast("string")))


class BKTree:
    """Nodes in arrays; each has a dictionary from distance to child. `met` hears of each pair that insertion compares."""

    def __init__(self, values: list[int], met=None) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for node in range(1, len(values)):
            at, value = 0, values[node]
            while True:
                distance = (values[at] ^ value).bit_count()
                if met is not None:
                    met(value, values[at], distance)
                step = self.children[at].setdefault(distance, node)
                if step == node:
                    break
                at = step

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most radius away from value."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for step, child in self.children[at].items():
                if d - radius <= step <= d + radius:
                    open_.append(child)
        return found


def tree_links(values: list[int], radius: int, links) -> None:
    """Join all distinct values within the radius.

    Insertion compares a value with its ancestors and joins what is near, which settles most of a dense cluster. Of a
    link still open, one end is outside the largest component, so only what is outside it searches.
    """
    tree = BKTree(values, lambda x, y, distance: distance <= radius and links.join(x, y))
    sizes: dict[int, int] = {}
    roots = [links.find(x) for x in values]
    for root in roots:
        sizes[root] = sizes.get(root, 0) + 1
    largest = max(sizes, key=sizes.get)
    outside = [value for value, root in zip(values, roots) if root != largest]
    if radius <= TREE_RADIUS:
        for value in outside:
            for j in tree.within(value, radius):
                links.join(value, values[j])
    elif outside:  # a tree would visit nearly all its nodes: the same by counting bits of all
        import numpy as np

        every = np.array(values, np.uint64)
        for value in outside:
            for j in np.flatnonzero(np.bitwise_count(every ^ np.uint64(value)) <= radius).tolist():
                links.join(value, values[j])


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i < more)
        out.append(bits[at : at + n])
        at += n
    return out


def _shard_edges(values: list[int], bits: list[int], radius: int, shard_rows: int, links) -> None:
    """Join all values within the radius; values are distinct and agree outside `bits`."""
    if len(values) <= shard_rows or len(bits) <= radius + 1:
        tree_links(values, radius, links)
        return
    for block in _blocks(bits, radius + 1):
        mask = sum(1 << b for b in block)
        groups: dict[int, list[int]] = {}
        for value in values:
            groups.setdefault(value & mask, []).append(value)
        rest = [b for b in bits if b not in set(block)]
        for group in groups.values():
            if len(group) > 1:
                _shard_edges(group, rest, radius, shard_rows, links)


def _linker(radius: int, shard_rows: int):
    def link(batches):
        import pyarrow as pa

        # rows come sorted by shard: a shard's rows follow one another, over batch borders too
        shard, values = None, []

        def flush():
            links = common.UnionFind()
            block = _blocks(list(range(64)), radius + 1)[shard[0]]
            rest = [b for b in range(64) if b not in set(block)]
            _shard_edges([v & (2**64 - 1) for v in values], rest, radius, shard_rows, links)
            pairs = [(x, links.find(x)) for x in links.up]
            signed = lambda x: x - 2**64 if x >= 2**63 else x
            return pa.RecordBatch.from_arrays(
                [pa.array([signed(a) for a, _ in pairs], pa.int64()), pa.array([signed(b) for _, b in pairs], pa.int64())],
                names=["u", "v"],
            )

        for batch in batches:
            for where, key, value in zip(*(batch.column(n).to_pylist() for n in ("block", "bits", "fp"))):
                if (where, key) != shard:
                    if len(values) > 1:
                        yield flush()
                    shard, values = (where, key), []
                values.append(value)
        if len(values) > 1:
            yield flush()

    return link


def links(fingerprints: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, depth: int = 1) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp` within the radius, a forest for each shard.

    A first shuffle counts the members of each shard. Shards over `shard_rows` are dealt out by a second block
    of bits as well (again one of radius + 1 blocks of the bits left, so no pair is lost), so that no task gets a
    hot shard whole.
    """
    masks = [sum(1 << b for b in block) for block in _blocks(list(range(64)), radius + 1)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    spread = fingerprints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
        ).alias("s"),
    ).select("fp", "s.block", "s.bits")
    sizes = spread.groupBy("block", "bits").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > shard_rows).select(F.col("block").alias("hb"), F.col("bits").alias("hk"))
    cold = spread.join(hot, (F.col("block") == F.col("hb")) & (F.col("bits") == F.col("hk")), "left")
    # Sub-blocks of the bits left, per first block, only for hot shards
    subs = []
    for block in _blocks(list(range(64)), radius + 1):
        rest = [b for b in range(64) if b not in set(block)]
        subs.append([sum(1 << b for b in sub) for sub in _blocks(rest, radius + 1)])
    sub_arrays = F.array(*[F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in s]) for s in subs])
    keyed = cold.select(
        "fp", "block", "bits",
        F.posexplode(F.when(F.col("hb").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.element_at(sub_arrays, F.col("block") + 1))).alias("part", "sub"),
    )
    dealt = keyed.repartition("block", "bits", "part", "sub").sortWithinPartitions("block", "bits", "part", "sub")
    shards = dealt.select("fp", "block", F.concat_ws(":", "bits", "part", "sub").alias("bits"))
    return shards.mapInArrow(common.tidy(_linker(radius, shard_rows)), "u long, v long")


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints (doc_id, fp) -> one row per fingerprint: fp_, root (a fingerprint that names the class), component_id (its least doc_id).

    Rows of one fingerprint are merged before anything is compared, so thousands of copies cost one node.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = common.components(links(nodes.select("fp"), radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a renewed key, so that a class with very many fingerprints may be split
    least = least.select(F.col("root").bitwiseXOR(F.lit(1)).alias("top"), "component_id")
    return rooted.join(least, F.col("root").bitwiseXOR(F.lit(1)) == F.col("top")).select(F.col("fp").alias("fp_"), "root", "component_id")


def _prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    only = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.cut(with_fingerprint(only, "fp").select("doc_id", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id (least doc_id reachable by links)."""
    prints = _prints(docs, doc_id, text)
    return prints.join(classes(prints, radius), F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
