"""Token ids as files: canonical length-limited Huffman codes from global counts, in blocks that decode on their own.

`encode` turns texts into ids, `write` puts them into files, `read` gives the documents back with their place among all ids.

The format is a folder with two Parquet tables. `codebook` has one row per used id and its code length; codes follow from the lengths
alone (canonical: shorter first, equal lengths by id). `blocks` has one row per block: `file` and `block` number it, `first` counts the ids of
the file before it, `doc_ids` and `doc_tokens` name the documents in it, `bits` holds their codes, most significant bit first, and `offsets`
has the bit offset of every `STRIDE`-th id. A block holds whole documents and closes once it has `BLOCK_TOKENS` ids. Files are ranges
of doc_id, in ascending order, and so are the rows of a file. A reader needs the codebook and any one block; it decodes from all of the
block's checkpoints at once, by one look-up of the next `limit` bits in a table for each id.

No more than `vocabulary` counts come to the driver, and one row per file when reading. Lengths of at most `limit` bits come from package-merge.

Texts are cut at ASCII white space and where runs of ASCII letters end, and the library encodes each distinct piece once: neither the
normaliser nor the splitting pattern of the vocabulary looks across such places, so the ids of a text are those of its pieces (tested against
whole texts).

Defined results: null text is empty and has the end id alone; null doc_id comes first; rows with equal doc_id are ordered by number of ids, then by
checksum, and each has its own place; a very long text is one block of its own; bytes that are no UTF-8 count as U+FFFD; strings of special
tokens in a text are ordinary text; an empty table gives files without blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import common

END = 2
BLOCK_TOKENS = 1 << 16
STRIDE = 256
#: Ids a file should have at most, and at least where the session's shuffle partitions allow so many files.
FILE_TOKENS = (1 << 18, 1 << 26)
#: Pieces and ids that a worker keeps before its table starts anew.
MAX_PIECES, MAX_POOL = 1_000_000, 8_000_000

ENCODED = "doc_id long, n_tokens long, ids binary"
BLOCKS = "file int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets array<long>, bits binary"
DECODED = "file int, doc_id long, start_in_file long, n_tokens long, ids binary"


# --- texts to ids


#: The splitting pattern under which texts may be cut within words; for other vocabularies only white space cuts.
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: other ASCII, letters A-Z and a-z, white space, not ASCII.
OTHER, LETTER, SPACE, WIDE = range(4)


@lru_cache(maxsize=1)
def _bytes():
    """Each byte's kind and its lower case."""
    import numpy as np

    kinds, lower = np.full(256, WIDE, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[:128] = OTHER
    kinds[[32, *range(9, 14)]] = SPACE
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    lower[65:91] += 32
    return kinds, lower


class Encoder:
    """Texts to ids by the tokenizers library, each distinct piece of a word once."""

    def __init__(self, path: str) -> None:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        form = json.loads(self.tokenizer.to_str())
        suffix = form["model"].get("end_of_word_suffix")
        self.cut = bool(suffix) and SPLITTING in json.dumps(form["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.last = np.zeros(size, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known: dict[bytes, int] = {}
        self.ends, self.pool = np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _learn(self, pieces: list[bytes]) -> None:
        import numpy as np

        run = lambda texts: [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # letters make one word each, whose last id says so; they go through the library many at once
        plain = [p for p in pieces if self.cut and p.isalpha()]
        found = []
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = np.array(run([b" ".join(part).decode()])[0], self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word without a last id")
            found.append((ids, np.diff(ends, prepend=0)))
        others = [p for p in pieces if not (self.cut and p.isalpha())]
        own = run([p.decode("utf-8", "replace") for p in others])
        found.append((np.array([i for x in own for i in x], self.kind), np.array([len(x) for x in own], np.int64)))
        self.known.update(zip(plain + others, range(len(self.known), len(self.known) + len(pieces))))
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in found)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([n for _, n in found]))])

    def encode(self, texts):
        """(ids of all texts, one behind the other, and each text's end), the end id after each text. texts: an Arrow string array."""
        import numpy as np
        import pyarrow as pa

        if len(self.known) > MAX_PIECES or len(self.pool) > MAX_POOL:
            self.clear()
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.full(len(texts), END, self.kind), np.arange(1, len(texts) + 1)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds, lower = _bytes()
        kind = kinds[data]
        before, after = kind[:-1], kind[1:]
        cut = (before == SPACE) | (after == SPACE)
        if self.cut:
            # letters end and begin there, whatever stands around them; but what follows an apostrophe may belong to it
            cut |= (before + after == OTHER + LETTER) & (data[:-1] != ord("'"))
        begins = np.concatenate([[True], cut & (before != after)])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = np.flatnonzero(begins)
        # a letter before a byte that is no ASCII may be composed with it first
        plain = np.where(np.concatenate([after == WIDE, [False]]), data, lower[data])
        bounds = np.append(begins, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(plain)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        each = pieces.indices.to_numpy()
        n = (self.ends[place + 1] - self.ends[place])[each]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.ends[place][each] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(begins, offsets[1:])]
        return np.insert(ids, ends, END), ends + np.arange(1, len(ends) + 1)


@common.worker_cache
def encoder(path: str) -> Encoder:
    """One in each worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the end id), ids (little-endian, of two bytes if the vocabulary allows it)."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = encoder(path)
        for batch in batches:
            ids, ends = own.encode(batch.column(1))
            offsets = np.concatenate([[0], ends])
            data = pa.py_buffer(ids.tobytes())
            places = pa.py_buffer((offsets * own.kind.itemsize).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, places, data])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), binary], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(common.tidy(run), ENCODED)


# --- codes


def code_lengths(counts, limit: int):
    """Lengths of at most `limit` bits of the best prefix code, by package-merge. counts: positive, ascending."""
    import numpy as np

    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    weights = np.asarray(counts, np.int64)
    leaves = []  # for each level, which entries of the merged list are single ids
    level = weights
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaves.append(order < n)
        level = merged[order]
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        single = int(leaf[:taken].sum())
        lengths[:single] += 1
        taken = 2 * (taken - single)
    lengths[:taken] += 1
    return lengths


def limit_for(used: int) -> int:
    """Bits enough for every used id, with room for shorter codes of frequent ones."""
    return max(16, (max(used, 1) - 1).bit_length() + 2)


class Code:
    """The canonical code of (id, length) rows: codes for writing, a table for reading."""

    def __init__(self, ids: list[int], lengths: list[int]) -> None:
        import numpy as np

        ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.limit = int(lengths.max(initial=1))
        spans = np.left_shift(np.int64(1), self.limit - lengths)
        begins = np.cumsum(spans) - spans  # codes, filled up to `limit` bits
        size = int(ids.max(initial=0)) + 1
        self.length, self.code = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length[ids], self.code[ids] = lengths, begins >> (self.limit - lengths)
        table = np.repeat((ids << 5 | lengths).astype(np.uint32), spans)
        self.table = np.concatenate([table, np.zeros((1 << self.limit) - len(table), np.uint32)])

    def pack(self, ids):
        """(bits, offsets of every STRIDE-th id)."""
        import numpy as np

        lengths = self.length[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        at = ends - lengths
        # a code lies in at most two neighbouring words of 32 bits
        shifted = self.code[ids] << (64 - lengths - (at & 31)).astype(np.uint64)
        words, first = np.unique(at >> 5, return_index=True)
        sums = np.add.reduceat(shifted, first)  # fields don't overlap, so a sum is a union
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[words] += sums >> np.uint64(32)
        out[words + 1] += sums & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], at[::STRIDE]

    def unpack(self, blocks: list[tuple[bytes, list[int], int]]):
        """Ids of all blocks (bits, offsets, number of ids), one behind the other."""
        import numpy as np

        data = b"".join(b"".join((bits, b"\0\0\0\0")) for bits, _, _ in blocks)
        window = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))
        bases = accumulate((len(bits) + 4 for bits, _, _ in blocks), initial=0)
        places = np.concatenate([np.asarray(offsets, np.int64) + base * 8 for base, (_, offsets, _) in zip(bases, blocks)])
        counts = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for _, _, n in blocks])
        into = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")  # runs that end early come last
        places, into = places[order], into[order]
        running = np.searchsorted(-counts[order], -np.arange(1, STRIDE + 1), side="right")
        out = np.empty(int(counts.sum()), np.uint32)
        drop, mask = 32 - self.limit, (1 << self.limit) - 1
        for step, n in enumerate(running.tolist()):
            if not n:
                break
            at = places[:n]
            found = self.table[(window[at >> 3] >> (drop - (at & 7))) & mask]
            out[into[:n] + step] = found >> 5
            at += found & 31
        return out


def codebook(encoded: DataFrame, wide: bool = False) -> DataFrame:
    """id and length of every used id. Counts are summed in each task first; the driver sees one row per used id."""
    spark = encoded.sparkSession

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4" if wide else "<u2"))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["n"], r["id"]))
    lengths = code_lengths([r["n"] for r in rows], limit_for(len(rows)))
    return spark.createDataFrame([(r["id"], int(k)) for r, k in zip(rows, lengths)], "id long, length long")


# --- files


def write(encoded: DataFrame, path: str, wide: bool = False) -> None:
    """Documents (doc_id, n_tokens, ids) to files under path. encoded should be cut: it is read three times."""
    spark = encoded.sparkSession
    codes = codebook(encoded, wide).orderBy("id").coalesce(1)
    codes.write.mode("overwrite").parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast([tuple(map(int, r)) for r in codes.collect()])  # at most the vocabulary
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_files = max(1, -(-total // FILE_TOKENS[1]), min(session, -(-total // FILE_TOKENS[0])))

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        code, file = None, TaskContext.get().partitionId()
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        docs, sizes, parts = [], [], []
        first = block = 0

        def close():
            nonlocal first, block
            ids = np.frombuffer(b"".join(parts), "<u4" if wide else "<u2")
            bits, offsets = code.pack(ids)
            row = [file, block, first, len(ids), list(docs), list(sizes), offsets.tolist(), bits]
            first, block = first + len(ids), block + 1
            docs.clear(), sizes.clear(), parts.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        held = 0
        for batch in batches:
            code = code or Code(*zip(*book.value))
            for doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(doc_id), sizes.append(n), parts.append(ids)
                held += n
                if held >= BLOCK_TOKENS:
                    yield close()
                    held = 0
        if held:
            yield close()

    # equal ids, even a third of all rows, are dealt by what tells them apart
    keys = ["doc_id", "n_tokens", "tie", "row"]
    ordered = encoded.withColumns({"tie": F.crc32("ids"), "row": F.monotonically_increasing_id()}).repartitionByRange(int(n_files), *keys)
    packed = ordered.sortWithinPartitions(*keys).select("doc_id", "n_tokens", "ids").mapInArrow(common.tidy(pack), BLOCKS)
    packed.write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian, of four bytes), from the files alone."""
    common.bounded_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    book = spark.sparkContext.broadcast([tuple(r) for r in spark.read.parquet(f"{path}/codebook").collect()])  # at most the vocabulary
    sizes = sorted(blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    bases = list(zip([r["file"] for r in sizes], accumulate((r["n"] for r in sizes), initial=0)))
    base = F.broadcast(spark.createDataFrame(bases, "file int, base long"))

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        code = None
        for batch in batches:
            if not len(batch):
                continue
            code = code or Code(*zip(*book.value))
            file, first, n, docs, tokens, offsets, bits = (batch.column(k) for k in (0, 2, 3, 4, 5, 6, 7))
            rows = list(zip(bits.to_pylist(), offsets.to_pylist(), n.to_pylist()))
            ids = code.unpack(rows).astype("<u4")
            sizes = tokens.flatten().to_numpy()
            ends = np.cumsum(sizes)
            per = np.diff(docs.offsets.to_numpy())
            # places in a file: from the block's first id on
            shift = np.repeat(first.to_numpy() - (np.cumsum(n.to_numpy()) - n.to_numpy()), per)
            places = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, places, pa.py_buffer(ids.tobytes())])
            files = pa.array(np.repeat(file.to_numpy(), per), pa.int32())
            columns = [files, docs.flatten(), pa.array(ends - sizes + shift, pa.int64()), tokens.flatten(), binary]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DECODED.split(", ")])

    found = blocks.mapInArrow(common.tidy(unpack), DECODED).join(base, "file")
    return found.select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def op11_huffman_ids(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    encoded = common.cut(encode(docs, common.tokenizer_path("word_bpe_49k.json")))
    path = f"{common.ensure_checkpoint_dir(spark)}/op11-{uuid.uuid4().hex}"
    write(encoded, path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
