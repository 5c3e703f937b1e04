"""Token files against the tokenizers library on whole texts, codes against an independent Huffman, blocks on their own."""

import collections
import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import common, registry, token_file

SF = "/root/testdata/sf0.001"
PATH = common.tokenizer_path("word_bpe_49k.json")
OP = registry.queries()["op11_huffman_ids"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids + [token_file.END]


def by_force(library, rows):
    encoded = sorted(((d, library(t or "")) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(np.array(r[1], "<u2").tobytes())))
    at = 0
    for doc_id, ids in encoded:
        yield doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def rows_of(found):
    return sorted(map(tuple, found), key=lambda r: r[1])


def test_whole_table(spark, small, library):
    assert rows_of(OP(spark, SF).collect()) == list(by_force(library, small))


def test_hard_rows(spark, save, hard_docs, library):
    folder = save(*hard_docs)
    assert rows_of(OP(spark, folder).collect()) == list(by_force(library, [r[:2] for r in hard_docs[0]]))


def test_pieces_are_whole_texts(library):
    """Places where texts are cut, or must not be: apostrophes, marks, digits, composed letters, other white space, special tokens."""
    parts = ["don't", "'S", "'", "''ll", "l'été", "H̱h", "J̌j", "É", "É.", "x.́y", "A", "z9", "3.5", "<|endoftext|>", " ", "　b", "\x1c", "ſ", "İI", "K", "日本", "🤦a", ",'s", "a_b", "\t\n", " ", "Ünï,", "İ", "a" * 3000]
    r = np.random.default_rng(5)
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 12))) for _ in range(3000)] + parts + [None, ""]
    own = token_file.Encoder(PATH)
    assert own.cut
    for batch in (texts[:1000], texts[1000:]):
        ids, ends = own.encode(pa.array(batch, pa.string()))
        found = [x.tolist() for x in np.split(ids, ends)[:-1]]
        for text, x in zip(batch, found):
            assert x == library(text or ""), repr(text)


def test_encoder_that_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_file, "MAX_PIECES", 5)
    own = token_file.Encoder(PATH)
    for text in ("one two three four", "five six seven eight nine ten", "one ten"):
        assert own.encode(pa.array([text]))[0].tolist() == library(text)


def optimum(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


def best_limited(counts, limit):
    """Least cost of a prefix code within the limit, over all length lists that Kraft's inequality allows (few symbols)."""
    best = None

    def walk(k, room, least, cost):
        nonlocal best
        if k == len(counts):
            best = cost if best is None else min(best, cost)
            return
        for n in range(least, limit + 1):  # longest codes go to the least counts
            if (1 << (limit - n)) <= room:
                walk(k + 1, room - (1 << (limit - n)), n, cost + n * counts[-1 - k])

    walk(0, 1 << limit, 1, 0)
    return best


def test_lengths_are_optimal():
    r = np.random.default_rng(2)
    for _ in range(60):
        counts = sorted(int(x) for x in (r.pareto(0.5, r.integers(2, 300)) * 5 + 1).clip(1, 10**12))
        lengths = token_file.code_lengths(counts, 40)
        assert sum(c * n for c, n in zip(counts, lengths.tolist())) == optimum(counts)
        limit = max(1, (len(counts) - 1).bit_length())
        short = token_file.code_lengths(counts, limit)
        assert short.max() <= limit and sum(2.0 ** -n for n in short.tolist()) <= 1
    for _ in range(40):
        counts = sorted(int(x) for x in r.pareto(0.6, r.integers(2, 8)) * 9 + 1)
        for limit in range((len(counts) - 1).bit_length() or 1, 6):
            found = token_file.code_lengths(counts, limit).tolist()
            assert sum(c * n for c, n in zip(counts, found)) == best_limited(counts, limit)
    assert token_file.code_lengths([7], 16).tolist() == [1] and token_file.code_lengths([], 16).tolist() == []
    with pytest.raises(ValueError):
        token_file.code_lengths([1, 1, 1], 1)


def test_blocks_alone():
    """Any block decodes without the others; codes are canonical; lengths at block and stride ends."""
    r = np.random.default_rng(3)
    for used, sizes in ((1, [1, 5]), (2, [1, 255, 256, 257]), (5000, [1, 511, 512, 513, 7000]), (49408, [3000])):
        ids = np.sort(r.choice(49408, used, replace=False))
        counts = np.sort(r.integers(1, 10_000, used))
        code = token_file.Code(ids.tolist(), token_file.code_lengths(counts, token_file.limit_for(used)).tolist())
        kept = sorted((int(code.length[i]), int(i)) for i in ids)
        words = [format(int(code.code[i]), f"0{n}b") for n, i in kept]
        assert words == sorted(words) and all(not b.startswith(a) for a, b in zip(words, words[1:]))
        blocks, plain = [], []
        for n in sizes:
            own = r.choice(ids, n).astype("<u2")
            bits, offsets = code.pack(own)
            blocks.append((bits, offsets.tolist(), n))
            plain.append(own)
            assert code.unpack(blocks[-1:]).tolist() == own.tolist()
            bit_text = "".join(format(int(code.code[i]), f"0{int(code.length[i])}b") for i in own)
            assert bits == int(bit_text + "0" * (-len(bit_text) % 8), 2).to_bytes(-(-len(bit_text) // 8), "big")
        assert code.unpack(blocks).tolist() == np.concatenate(plain).tolist()


def test_files_are_in_order(spark, tmp_path, monkeypatch):
    """Several files and blocks; one id has a third of all rows; files are ranges in ascending order, and a second write is the same."""
    monkeypatch.setattr(token_file, "FILE_TOKENS", (100, 1 << 26))
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 64)
    rows = [(7 if i % 3 == 0 else i, f"word{i % 11} and other words {'more ' * (i % 9)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    encoded = common.cut(token_file.encode(docs, PATH))
    path = str(tmp_path / "files")
    seen = []
    for _ in range(2):
        token_file.write(encoded, path)
        blocks = spark.read.parquet(f"{path}/blocks").orderBy("file", "block").collect()
        assert len({b["file"] for b in blocks}) > 2 and len(blocks) > 20
        ids = [d for b in blocks for d in b["doc_ids"]]
        assert ids == sorted(i for i, _ in rows)
        assert all(b["n_tokens"] == sum(b["doc_tokens"]) for b in blocks)
        seen.append(sorted(map(tuple, token_file.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect())))
    assert seen[0] == seen[1]
    assert sorted(r[1] for r in seen[0]) == [0, *np.cumsum([r[2] for r in sorted(seen[0], key=lambda r: r[1])])[:-1].tolist()]


def test_files_are_smaller_than_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoded = common.cut(token_file.encode(docs, PATH))
    token_file.write(encoded, str(tmp_path / "f"))
    rows = encoded.select("ids").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows])
    counts = np.array(list(collections.Counter(ids.tolist()).values()))
    entropy = -(counts * np.log2(counts / counts.sum())).sum()
    bits = sum(8 * len(r["bits"]) for r in spark.read.parquet(str(tmp_path / "f/blocks")).select("bits").collect())
    assert entropy <= bits <= 1.05 * entropy + 8 * 1000
    assert not os.path.exists(tmp_path / "f/blocks/_temporary")
