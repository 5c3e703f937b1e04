"""Each operator's query against brute force, on the smallest tables and on hard rows."""

import bisect
import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ctxspark.llm import bloom_lm, bpe, common, crf_quality, embedding_dedup, mixing, quality_rules, registry, sharding, simhash, similar_texts, substring, word_pieces

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
QUERIES = registry.queries()
EMPTY = [("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("labels", "doc_id long, quality int, toxic int")]


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def empty(save):
    folder = None
    for name, schema in EMPTY:
        folder = save([], schema, name, folder)
    return folder


@pytest.fixture(scope="module")
def hard(save, hard_docs):
    folder = save(*hard_docs)
    save([(1, 1, 0), (4, 0, 0), (7, 1, None), (None, 1, 1), (8, None, 0)], EMPTY[2][1], "labels", folder)
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op7_rotated_codes", "op3_temperature_mixing", "op12_source_divergence")))
def test_hard_rows_come_out_once_each(spark, hard, hard_docs, name):
    found = QUERIES[name](spark, hard).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r[0] for r in hard_docs[0])


# --- 1


def greedy(word, initial, continuing):
    n = at = 0
    while at < len(word):
        pieces = continuing if at else initial
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_token_counts(spark, small):
    sets = word_pieces.pieces(bpe.read_ranks(common.tokenizer_path("byte_bpe_50k.tiktoken")))
    known = {}
    for row in QUERIES["op1_linear_longest_match"](spark, SF).collect():
        words = dict(small)[row["doc_id"]].encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy(w, *sets)
        assert (row["n_words"], row["n_tokens"], row["n_unknown"]) == (len(words), sum(known[w] for w in words), 0)


def test_automaton_with_failures():
    initial, continuing = {b"a", b"ab", b"abc", b"b"}, {b"b", b"bcd", b"c", b"d"}
    own = word_pieces.Automaton(initial, continuing)
    r = np.random.default_rng(1)
    for _ in range(3000):
        word = bytes(r.choice(list(b"abcdx"), r.integers(1, 9)).tolist())
        assert own.count(word) == greedy(word, initial, continuing), word


# --- 2


def cut_by_force(rows, window=substring.WINDOW):
    words = [WORD.findall(t) for _, t in rows]
    counts = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        yield doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def cut_rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)


def test_substring_dedup(spark, small):
    assert cut_rows(QUERIES["op2_substring_cms"](spark, SF).collect()) == sorted(cut_by_force(small), key=str)


def test_substring_dedup_of_hard_rows(spark, hard, hard_docs):
    assert cut_rows(QUERIES["op2_substring_cms"](spark, hard).collect()) == sorted(cut_by_force(texts(hard_docs[0])), key=str)


def test_substring_dedup_of_periodic_and_shared_texts(spark, save):
    """Windows that repeat within a text, at its ends, and across texts with other neighbours; few kinds of words make many ties."""
    r = np.random.default_rng(3)
    shared = " ".join(f"s{i}" for i in range(52))
    rows = [(0, "a " * 100), (1, "a b " * 40), (2, "a " * 34), (3, " ".join(f"u{i}" for i in range(40)) + " a" * 35)]
    rows += [(10 + i, " ".join(f"x{j}" for j in r.integers(0, 3, 60)) + " " + shared + f" end{i} " + shared[: 40 + 7 * i]) for i in range(12)]
    rows += [(50 + i, " ".join(f"y{j}" for j in r.integers(0, 2, 300))) for i in range(6)]
    folder = save([(i, t, "en", "a", 1) for i, t in rows])
    assert cut_rows(QUERIES["op2_substring_cms"](spark, folder).collect()) == sorted(cut_by_force(rows), key=str)


def test_substring_dedup_in_pieces(spark, small, save, monkeypatch):
    """Texts cut into small overlapping pieces: every window is in one piece, and results are the same."""
    words = [f"w{i}" for i in range(300)]
    text = " \n".join(words).encode() + b" "
    for size in (1, 7, 50, 333):
        met = []
        for before, piece in substring.pieces(text, size):
            own = [w.decode() for w in piece.split()]
            met += [(before + i, own[i : i + 35]) for i in range(len(own) - 34)]
        assert met == [(i, words[i : i + 35]) for i in range(266)]
    monkeypatch.setattr(substring, "PIECE_BYTES", 400)
    assert cut_rows(spark_rows(spark, save, small)) == sorted(cut_by_force(small), key=str)


def spark_rows(spark, save, rows):
    """op2's rows, the scans running in this process so that patches hold."""
    docs = [t.encode() for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.binary())], names=["text"])
    everything = collections.namedtuple("Shared", "value")(collections.namedtuple("All", "may_hold")(lambda keys: np.ones(len(keys), bool)))
    places = [r for part in substring._place_scan(everything, everything, everything)([batch]) for r in part.to_pylist()]
    windows = collections.Counter((r["a"], r["b"]) for part in substring._window_scan(everything, everything)([batch]) for r in part.to_pylist())
    copies = collections.Counter(docs)
    by = collections.defaultdict(set)
    for r in places:  # spans of one window are enough: the scan lists all single windows too
        start, end = r["place"] >> 32, r["place"] & 0xFFFFFFFF
        if end - start == 35 and windows[r["a"], r["b"]] > 1 or copies[next(d for d in copies if hashlib.md5(d).digest() == r["t"])] > 1:
            by[r["t"]].add(r["place"])
    out = []
    for (doc_id, _), d in zip(rows, docs):
        found = by[hashlib.md5(d).digest()]
        words, gone = d.split(), set()
        for place in found:
            gone |= set(range(place >> 32, place & 0xFFFFFFFF))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append({"doc_id": doc_id, "n_words": len(words), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def test_substring_dedup_of_bytes_that_are_no_text(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = spark.sql(f"SELECT id AS doc_id, concat(CAST(X'FF4120C328' AS STRING), ' {shared} ', CAST(id AS STRING), CAST(X'20E697' AS STRING)) AS text FROM range(3)")
    for r in substring.with_removed(docs, "cut").select("doc_id", "cut.*").collect():
        kept = str(r["doc_id"]).encode() + b" \xe6\x97"
        assert (r["n_words"], r["n_removed"], bytes(r["kept"]), r["kept_sha256"]) == (44, 42, kept, hashlib.sha256(kept).hexdigest())


def test_a_crowded_sketch_loses_nothing(spark, small, monkeypatch):
    monkeypatch.setattr(substring, "log_cells", lambda keys, threshold: 16)
    assert cut_rows(QUERIES["op2_substring_cms"](spark, SF).collect()) == sorted(cut_by_force(small), key=str)


# --- 3


def test_mixing_meets_the_limit_and_keeps_everything(spark, small):
    found = QUERIES["op3_temperature_mixing"](spark, SF).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in small}
    seen, tokens, own = collections.Counter(), collections.Counter(), collections.Counter()
    for r in found:
        seen[r["doc_id"], r["pass"]] += 1
        tokens[r["source"]] += r["n_tokens"]
        if r["pass"] == 0:
            own[r["source"]] += r["n_tokens"]
    assert set(seen.values()) == {1}
    assert max(tokens[s] / own[s] for s in own) <= mixing.MAX_PASSES + 1e-9
    weights = {r["source"]: r["weight"] for r in found}
    longest = max(len(WORD.findall(t)) for _, t in small)
    budget = max(own[s] / weights[s] for s in own)
    assert all(0 <= budget * weights[s] - tokens[s] <= longest + 1 for s in own)


def test_mixing_with_budget_and_entropy(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 4 else "small", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    found = mixing.mixed(docs, budget=500, target_entropy=0.95).select("source", "mix.n_tokens", "mix.weight").collect()
    total, weights = collections.Counter(), {}
    for r in found:
        total[r["source"]] += r["n_tokens"]
        weights[r["source"]] = r["weight"]
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(2)
    assert entropy == pytest.approx(0.95, abs=1e-6)
    assert all(500 * weights[s] - 8 <= total[s] <= 500 * weights[s] + 1 for s in weights)


def test_mixing_of_hard_rows(spark, hard, hard_docs):
    found = QUERIES["op3_temperature_mixing"](spark, hard).collect()
    assert {r["doc_id"] for r in found} == {r[0] for r in hard_docs[0]}
    assert sum(r["pass"] == 0 for r in found) == len(hard_docs[0])


def test_mixing_is_native(spark):
    plan = QUERIES["op3_temperature_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4


def test_bpe_is_tiktoken(spark, small, hard, hard_docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for folder, rows in ((SF, small), (hard, texts(hard_docs[0]))):
        expected = []
        for doc_id, text in rows:
            ids = theirs.encode_ordinary(text)
            expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        found = [tuple(r) for r in QUERIES["op4_bpe_transducer"](spark, folder).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_bpe_transducer_on_random_bytes(monkeypatch):
    """Full tables, and tokens sent from time to time, give the same ids."""
    own = bpe.Transducer({**{bytes((b,)): b for b in range(256)}, **{t: 256 + i for i, t in enumerate([b"ab", b"bc", b"abc", b"ca", b"aa", b"aaaa", b"bca", b"cab"])}})
    r = np.random.default_rng(2)
    for states, steps, look in ((10**6, 10**6, 4096), (3, 10**6, 4096), (10**6, 5, 4096), (10**6, 10**6, 1), (4, 7, 5)):
        monkeypatch.setattr(bpe, "MAX_STATES", states)
        monkeypatch.setattr(bpe, "MAX_STEPS", steps)
        monkeypatch.setattr(bpe, "LOOK", look)
        for _ in range(2000):
            piece = bytes(r.choice(list(b"abcd"), r.integers(1, 30)).tolist())
            assert np.frombuffer(own.encode(piece), "<u4").tolist() == own.merged(piece), piece


def test_bpe_states_encode_every_piece_that_is_no_token(spark, monkeypatch):
    """With the settings in use: bytes that went through transitions are those of all pieces met first that are no tokens."""
    import tiktoken

    path, pattern = bpe.vocabulary()
    own, walked = bpe.Codec(path, pattern), []
    walk = own.pieces.transducer._walk
    monkeypatch.setattr(own.pieces.transducer, "_walk", lambda state, piece, lasts: walked.append(len(piece)) or walk(state, piece, lasts))
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.pieces.transducer.ranks, special_tokens={})
    stored = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in stored:
        assert own.encode(text.encode()) == np.array(theirs.encode_ordinary(text), "<u4").tobytes()
    met = {p.encode() for t in stored for p in own.split(t)}
    assert sum(walked) >= sum(len(p) for p in met if p not in own.pieces.transducer.ranks) > 0
    assert 0 < own.pieces.transducer.made < sum(walked) / 2  # transitions are met again


def test_bpe_splits_at_spaces_as_the_pattern_does():
    import random

    own, r = bpe.Codec(*bpe.vocabulary()), random.Random(1)
    parts = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "a", "B", "'s", "'ll", "1", "²", "Ⅷ", ".", "日", "é", "_", "🤦", "\u200b", "\x00", "\r\n"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert own.encode(text.encode()) == own._plain(text), repr(text)


def test_utf8_in_any_pieces():
    text = "aé日🤦ß" * 5
    data = text.encode()
    for size in range(1, 7):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.end() == text
    for broken in (b"\xff", b"\xe6\x97", b"a\xf0\x9f", b"\xc3("):
        stream = bpe.Utf8Stream()
        assert stream.feed(broken) + stream.end() == broken.decode("utf-8", "replace")


# --- 5


def counts_by_force(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_counts(spark, small, hard, hard_docs):
    for folder, rows in ((SF, small), (hard, texts(hard_docs[0]))):
        found = QUERIES["op5_host_rules"](spark, folder).collect()
        expected = []
        for doc_id, text in rows:
            c = counts_by_force(text)
            expected.append((doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
        assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(expected, key=str)
        assert not any(r["base_failed"] and r["kept"] for r in found)


def test_windows_of_many_words():
    r = np.random.default_rng(6)
    for n in (0, 4, 5, 6, 50, 400):
        for kinds in (1, 2, 9, 1000):
            words = [b"w%d" % k for k in r.integers(0, kinds, n)]
            if n >= 5:
                assert quality_rules._repeat_words_of_many(words) == quality_rules.repeat_words(words)
    long = [b"a%d" % (i % 70_000) for i in range(150_000)]
    assert quality_rules.repeat_words(long) == 150_000 and quality_rules.repeat_words(long[:70_004] + [b"z%d" % i for i in range(50_000)]) == 0
    assert quality_rules.counts(b" ".join(long))[5] == 150_000


GOOD = "These are plain words that nobody would ever want to reject from a corpus, number {}."
NOISY = "Bad### words$$$ with*** many%%% signs&&& in||| each<<< and>>> every### one$$$ here {}."


def judged(spark, rows):
    counted = quality_rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    hosts = quality_rules.host_verdicts(counted)
    return {r["doc_id"] for r in quality_rules.judge(counted, hosts).where("verdict.kept").collect()}, {r["host_key"] for r in hosts.where("bad_symbols").collect()}


def test_a_bad_host_loses_what_breaks_its_rule(spark):
    """The same noisy text is rejected where most are noisy and kept elsewhere; a rule that is broken everywhere alike makes no host bad."""
    rows = [(i, (NOISY if i % 10 else GOOD).format(i), "bad") for i in range(100)]
    rows += [(1000 + i, (NOISY if i < 20 else GOOD).format(i), f"host{i % 20}") for i in range(2000)]
    kept, bad = judged(spark, rows)
    assert kept == {i for i in range(0, 100, 10)} | {1000 + i for i in range(2000)} and bad == {"=bad"}
    alike = [(i, (NOISY if i % 100 < 20 else GOOD).format(i), f"host{i // 100}") for i in range(2000)]
    kept, bad = judged(spark, alike)
    assert len(kept) == 2000 and not bad


def test_hosts_of_a_bad_corpus_are_bad(spark):
    rows = [(i, (NOISY if i % 4 else GOOD).format(i), f"host{i % 3}") for i in range(300)]
    kept, bad = judged(spark, rows)
    assert kept == set(range(0, 300, 4)) and len(bad) == 3


def test_host_verdicts_change_rows(spark):
    """On the common tables some hosts are bad and some aren't; what the verdict rejects isn't labelled good."""
    sf = "/root/testdata/sf0.01"
    counted = quality_rules.with_counts(spark.read.parquet(f"{sf}/documents.parquet")).drop("text")
    hosts = quality_rules.host_verdicts(counted).collect()
    assert 0 < sum(r["bad_symbols"] or r["bad_lines"] or r["bad_length"] for r in hosts) < len(hosts)
    found = QUERIES["op5_host_rules"](spark, sf).where("NOT base_failed AND NOT kept").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    rows = found.collect()
    assert rows and not any(r["quality"] == 1 for r in rows)


def test_host_verdicts_without_judged_documents(spark):
    rows = [(1, "too short", "a"), (2, None, None), (3, "plain words that make a text long enough to pass the base rule here", "b")]
    counted = quality_rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for part, expected in ((counted, {1: False, 2: False, 3: True}), (counted.where("doc_id < 3"), {1: False, 2: False})):
        assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(part, quality_rules.host_verdicts(part)).select("doc_id", "verdict.kept").collect()} == expected


# --- 6


def test_shards(spark, small, hard, hard_docs):
    for folder, rows in ((SF, small), (hard, texts(hard_docs[0]))):
        found = QUERIES["op6_bounded_ring"](spark, folder).collect()
        by = collections.defaultdict(list)
        for r in found:
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        expected = sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows if i is not None)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == expected


def test_shards_follow_from_the_ring(spark):
    """Row by row: what an arc's owner has room for stays, by hash, and what is left over goes on clockwise."""
    n, shards = 5000, 24
    frame = spark.range(n).select(F.col("id").alias("doc_id"))
    hashes = {r["doc_id"]: r["h"] % 2**64 for r in frame.withColumn("h", F.xxhash64("doc_id")).collect()}
    nodes = sharding.ring(shards)
    places = [p for p, _ in nodes]
    arcs = collections.defaultdict(list)
    for key, h in hashes.items():
        arcs[bisect.bisect_left(places, h >> 48) % len(nodes)].append((h - 2**64 if h >= 2**63 else h, key))
    room = [n // shards + (s < n % shards) for s in range(shards)]
    expected, over = {}, []
    for arc in sorted(arcs):
        for _, key in sorted(arcs[arc]):
            shard = nodes[arc][1]
            if room[shard]:
                room[shard] -= 1
                expected[key] = shard
            else:
                over.append((arc, key))
    for arc, key in over:
        while not room[nodes[arc][1]]:
            arc = (arc + 1) % len(nodes)
        room[nodes[arc][1]] -= 1
        expected[key] = nodes[arc][1]
    assert {r["doc_id"]: r["shard"] for r in sharding.sharded(frame, ["doc_id"], shards).collect()} == expected


def test_one_more_shard_moves_few(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    a = {r["doc_id"]: r["shard"] for r in sharding.sharded(rows, ["doc_id"], 24).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.sharded(rows, ["doc_id"], 25, cell_rows=2).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.1, moved  # 4 % have to move; dealing out anew would move 96 %


# --- 7


def test_embedding_links(spark, save):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 64))
    rows = [(i, (base[i % 40] + s * r.standard_normal(64)).tolist()) for i, s in enumerate(np.repeat([0.02, 0.15, 0.25, 0.4], 150))]
    rows += [(1000 + i, base[0].tolist()) for i in range(700)] + [(2000 + i, (base[1] + 1e-4 * r.standard_normal(64)).tolist()) for i in range(1500)]
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [float("inf")] * 64), (9004, [None] + [1.0] * 63), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, []), (0, rows[0][1])]
    folder = save([(i, v, 0) for i, v in rows], EMPTY[1][1], "embeddings")
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = [x["vec_id"] for x in stored]
    vectors = [np.array(x["embedding"], float) if x["embedding"] and None not in x["embedding"] else np.zeros(0) for x in stored]
    good = [len(v) > 0 and np.isfinite(v).all() and v.any() for v in vectors]
    n, links = len(ids), []
    for size in (2, 64):
        own = [i for i in range(n) if good[i] and len(vectors[i]) == size]
        x = np.stack([vectors[i] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += [(own[a], own[b]) for a, b in zip(*np.nonzero(x @ x.T >= 0.95)) if a != b]
    count = collections.Counter(a for a, _ in links)
    least = {}
    roots = components(n, links)
    for i, root in enumerate(roots):
        least[root] = min(least.get(root, ids[i]), ids[i])
    expected = sorted((ids[i], count[i], least[roots[i]], ids[i] == least[roots[i]]) for i in range(n))
    found = sorted(tuple(r) for r in QUERIES["op7_rotated_codes"](spark, folder).collect())
    assert found == expected


@pytest.mark.parametrize("size, rank, n", [(2, 2, 2500), (3, 3, 3000), (64, 4, 3000)])
def test_embedding_links_in_few_dimensions(spark, save, monkeypatch, size, rank, n):
    """Many cells, and vectors between them: every link is found."""
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 60)
    r = np.random.default_rng(size)
    x = (r.standard_normal((n, rank)) @ r.standard_normal((rank, size))).astype(np.float32)
    folder = save([(i, v.tolist(), 0) for i, v in enumerate(x)], EMPTY[1][1], "embeddings")
    unit = embedding_dedup.unit_of(x)
    a, b = np.nonzero(unit @ unit.T >= 0.95)
    links = [(int(i), int(j)) for i, j in zip(a, b) if i != j]
    count, roots = collections.Counter(i for i, _ in links), components(n, links)
    expected = [(i, count[i], roots[i], i == roots[i]) for i in range(n)]
    assert sorted(tuple(r) for r in QUERIES["op7_rotated_codes"](spark, folder).collect()) == expected


def test_embedding_links_match_sql(spark, save):
    """The SQL on a table that has links."""
    import duckdb

    r = np.random.default_rng(14)
    base = r.standard_normal((30, 8))
    rows = [(i, (base[i % 30] + s * r.standard_normal(8)).tolist(), 0) for i, s in enumerate(np.repeat([0.0, 0.1, 0.3], 60))] + [(900, None, 0), (901, [0.0] * 8, 0)]
    folder = save(rows, EMPTY[1][1], "embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    found = QUERIES["op7_rotated_codes"](spark, folder)
    expected = sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({embedding_dedup.OP7_SQL})").fetchall())
    assert sorted(tuple(r) for r in found.collect()) == expected and sum(e[1] for e in expected) > 100


def test_linked_vectors_meet_in_a_home():
    """Pivots at right angles, linked vectors on both sides of their middle: one of them visits the other's home."""
    pivots = np.eye(4)[:2]
    angles = np.radians(45 + np.array([-9.0, 9.0]))
    pair = np.stack([np.cos(angles), np.sin(angles), 0 * angles, 0 * angles], axis=1)
    assert pair[0] @ pair[1] >= 0.95
    r = np.random.default_rng(9)
    for own, x in ((pivots, pair), (embedding_dedup.unit_of(r.standard_normal((12, 4))), embedding_dedup.unit_of(r.standard_normal((1500, 4))))):
        home, visited = embedding_dedup.visits(x, own, embedding_dedup.margins(own, 0.95))
        a, b = np.nonzero(x @ x.T >= 0.95)
        assert (visited[a, home[b]] | visited[b, home[a]]).all()


def test_bounds_hold():
    r = np.random.default_rng(5)
    for size in (2, 3, 64, 100):
        x, y = (embedding_dedup.unit_of(r.standard_normal((300, size))) for _ in range(2))
        y[:150] = embedding_dedup.unit_of(x[:150] + 0.1 * r.standard_normal((150, size)))
        assert (embedding_dedup.upper_bounds(x, *embedding_dedup.encode(y)) >= x @ y.T - 1e-9).all()


# --- 8


def test_crf_gradient():
    """The gradient of the log-likelihood against differences."""
    r = np.random.default_rng(6)
    scores, moves = r.standard_normal((1, 5)), r.standard_normal((2, 2))
    mask = np.ones((1, 5), bool)

    def log_z(s, m):
        return math.log(sum(math.exp(sum(s[0, t] * y[t] for t in range(5)) + sum(m[y[t], y[t + 1]] for t in range(4))) for y in np.ndindex(2, 2, 2, 2, 2)))

    marginals, expected = crf_quality.forward_backward(scores, mask, moves)
    for t in range(5):
        up = scores.copy()
        up[0, t] += 1e-6
        assert (log_z(up, moves) - log_z(scores, moves)) / 1e-6 == pytest.approx(marginals[0, t], abs=1e-4)
    for i in np.ndindex(2, 2):
        up = moves.copy()
        up[i] += 1e-6
        assert (log_z(scores, up) - log_z(scores, moves)) / 1e-6 == pytest.approx(expected[i], abs=1e-4)


def test_crf_scores_by_force(spark, small):
    """The query's scores from all label sequences of the lines, on texts of few lines."""
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    field = crf_quality.train(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")), common.fold("doc_id", 4) != 2)
    found = {r["doc_id"]: r["score"] for r in QUERIES["op8_line_crf"](spark, SF).collect()}
    tried = 0
    for doc_id, text in small:
        own, weights = crf_quality.own_features(text.encode())
        if len(own) > 9:
            continue
        rows = ((crf_quality.with_neighbours(own, np.array([len(own)])) - field.mean) / field.scale) @ field.weights
        total, good = 0.0, np.zeros(len(own))
        for y in np.ndindex(*[2] * len(own)):
            p = math.exp(sum(np.clip(s, -30, 30) * v for s, v in zip(rows, y)) - sum(max(0, s) for s in np.clip(rows, -30, 30)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert found[doc_id] == pytest.approx(float((good / total * weights).sum() / weights.sum()), abs=1e-6)
        tried += 1
    assert tried > 50


def test_crf_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op8_line_crf"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    bad = sorted(s for s, y in held if y == 0)
    auc = np.mean([bisect.bisect_left(bad, s) / len(bad) for s, y in held if y == 1])
    assert auc > 0.9, auc


def test_crf_passes_over_what_does_not_fit(spark):
    """A many-lined text at the first place of the order leaves the other training texts in the sample."""
    first = spark.range(41).orderBy(F.xxhash64("id"), "id").first()["id"]
    rows = [(i, "Good plain words here." if i % 2 else "### $$$ %%% ***", i % 2) for i in range(41) if i != first]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(first, "line\n" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(first, 1)], "doc_id long, label int")
    field = crf_quality.train(docs, labels, F.lit(True), most_lines=100)
    scores = {r["doc_id"]: r["score"] for r in crf_quality.with_score(docs, field).collect()}
    assert all(scores[i] > 0.5 if y else scores[i] < 0.5 for i, _, y in rows)


def test_crf_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    field = crf_quality.train(docs, labels, F.lit(True))
    assert {r["score"] for r in crf_quality.with_score(docs, field).collect()} == {1.0}


# --- 9


def lm_by_force(rows):
    tokens = [(i, [*WORD.findall(t.translate(LOWER)), None], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    counts = collections.Counter(w for _, words, held in tokens if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    for i, words, held in tokens:
        yield i, held, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)


@pytest.mark.parametrize("head", [bloom_lm.HEAD_WORDS, 50])
def test_lm_base_scores(spark, small, hard, hard_docs, monkeypatch, head):
    monkeypatch.setattr(bloom_lm.train, "__defaults__", (head,))
    for folder, rows in ((SF, small), (hard, texts(hard_docs[0]))):
        key = lambda r: (str(r[0]), r[2])
        expected = sorted(lm_by_force(rows), key=key)
        found = sorted((tuple(r) for r in QUERIES["op9_bloom_lm"](spark, folder).collect()), key=key)
        assert [f[:5] for f in found] == [e[:5] for e in expected]
        assert [f[5] for f in found] == pytest.approx([e[5] for e in expected])


def test_lm_scores_are_better_than_the_base(spark):
    found = QUERIES["op9_bloom_lm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found["s"] > found["b"]


def test_lm_filter_gives_counts_back(spark):
    rows = [("common " * 1000,), ("rare thing",), *[(f"w{i} w{i + 1}",) for i in range(2000)]]
    model, _ = bloom_lm.train(spark.createDataFrame(rows, "text string"))
    keys = np.array([xxhash.xxh64_intdigest(w) for w in (b"common", b"rare", b"w7")], np.uint64)
    found = bloom_lm.level_counts()[model.filter.levels(bloom_lm.word_keys(keys))]
    assert found[0] == pytest.approx(1000, rel=0.3) and found[1] == 1 and found[2] == 2
    absent = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (model.filter.levels(absent) > 0).mean() < 0.05


@pytest.mark.parametrize("hard_rows, bits", [(False, 20), (True, 19)])
def test_lm_beyond_the_broadcast_bound(spark, hard, monkeypatch, hard_rows, bits):
    """A filter in shards takes all n-grams as well and gives the scores of a broadcast one."""
    folder = hard if hard_rows else "/root/testdata/sf0.01"
    rows = lambda: sorted((tuple(r) for r in QUERIES["op9_bloom_lm"](spark, folder).collect()), key=lambda r: (str(r[0]), r[2]))
    expected = rows()
    monkeypatch.setattr(bloom_lm, "MAX_LOG_BITS", bits)
    monkeypatch.setattr(bloom_lm, "SHARD_LOG_BITS", 21, raising=False)
    monkeypatch.setattr(bloom_lm, "GROUP_BYTES", 1 << 17, raising=False)
    found = rows()
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for at in (5, 6):
        assert [f[at] for f in found] == pytest.approx([e[at] for e in expected])


def test_lm_levels_stand_for_counts():
    table = bloom_lm.level_counts()
    for c in (1, 2, 3, 5, 10, 100, 12345):
        assert table[bloom_lm.quantise(np.array([c]))[0]] == pytest.approx(c, rel=0.34)


# --- 10


def prints_by_force(rows, width=4):
    for _, text in rows:
        words = WORD.findall(text.translate(LOWER))
        shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) > width else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        yield sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_by_force(rows):
    prints = list(prints_by_force(rows))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = components(len(rows), links)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return sorted(((i, f"{p:016x}", least.get(root)) for (i, _), p, root in zip(rows, prints, roots)), key=str)


def test_simhash(spark, small, hard, hard_docs):
    for folder, rows in ((SF, small), (hard, texts(hard_docs[0]))):
        assert sorted((tuple(r) for r in QUERIES["op10_simhash_bktree"](spark, folder).collect()), key=str) == simhash_by_force(rows)


def test_links_of_random_prints_with_hot_shards(spark):
    """Clusters of near prints, and shards so small that all are cut further."""
    r = np.random.default_rng(8)
    centres = r.integers(0, 2**63, 30, dtype=np.uint64)
    values = set()
    for c in centres:
        for _ in range(25):
            flips = r.choice(64, r.integers(0, 6), replace=False)
            values.add(int(c) ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    pairs = [(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 4]
    expected = components(len(values), pairs)
    for rows in (4, 100_000):
        frame = spark.createDataFrame([(s,) for s in signed], "fp long")
        found = common.components(simhash.links(frame, 4, shard_rows=rows)).collect()
        root = {x["node"]: x["root"] for x in found}
        groups, own = collections.defaultdict(set), collections.defaultdict(set)
        for i, s in enumerate(signed):
            groups[expected[i]].add(s)
            own[root.get(s, s)].add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def shingles_by_force(text, width=5):
    words = WORD.findall(text.translate(LOWER))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def alike_by_force(rows, similarity=0.8):
    """(doc_id, least doc_id of its group) for texts whose sets of five-word shingles are alike."""
    sets = [shingles_by_force(t) for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    roots = components(len(rows), links)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [(i, least.get(root)) for (i, _), root in zip(rows, roots)]


def edited(r, words, changes):
    words = list(words)
    for at in r.choice(len(words), changes, replace=False):
        words[at] = f"e{r.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_similar_texts(spark, small, hard_docs, monkeypatch, small_blocks):
    """Near copies by edits on both sides of the limit, copies of copies, the smallest documents and hard rows, against all pairs."""
    if small_blocks:
        monkeypatch.setattr(similar_texts, "BLOCK_SHINGLES", 500)
        monkeypatch.setattr(similar_texts.candidates, "__defaults__", (20,))
        monkeypatch.setattr(similar_texts, "LEADERS", 4)
        monkeypatch.setattr(common, "SMALL_EDGES", 0)
        monkeypatch.setattr(similar_texts, "BROADCAST_TEXTS", 0)
    r = np.random.default_rng(11)
    rows = [(i + 10_000, t) for i, t in small] + [(x[0], x[1] or "") for x in hard_docs[0]]
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(int(r.integers(5, 400)))]
        for k in range(8):
            rows.append((20_000 + 100 * g + k, edited(r, words, min(len(words) // 3, int(len(words) * 0.006 * k)))))
            if k % 3 == 2:
                words = rows[-1][1].split()
    expected = {(str(i), least) for i, least in alike_by_force(rows)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    found = similar_texts.classes(docs).collect()
    least = {}
    for x in found:
        if x["least"]["doc_id"] is not None:
            least[x["root"]] = min(least.get(x["root"], 10**9), x["least"]["doc_id"])
    by_digest = {bytes(x["t"]): least.get(x["root"]) for x in found}
    assert {(str(i), by_digest[hashlib.md5(t.encode()).digest()]) for i, t in rows} == expected
    kept = [x["doc_id"] for x in similar_texts.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted({least for _, least in expected}, key=str)


def test_members_of_a_hot_shard_all_meet(spark, monkeypatch):
    """Two fingerprints that share nothing but one very frequent min-hash are candidates, whatever blocks they are in."""
    monkeypatch.setattr(similar_texts, "LEADERS", 4)  # before, blocks met through so many
    r = np.random.default_rng(13)
    values = []
    for _ in range(150):
        value = int(r.integers(0, 2**64, dtype=np.uint64))
        values += [value, value ^ sum(1 << int(b) for b in r.choice(64, 6, replace=False))]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    rows = [(v, [7] + [1000 * i + k for k in range(1, similar_texts.KEYS)]) for i, v in enumerate(signed)]
    found = similar_texts.candidates(spark.createDataFrame(rows, "fp long, mins array<long>"), 8, 16).collect()
    pairs = [(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 8]
    assert len(pairs) >= 150
    at = {v: i for i, v in enumerate(signed)}
    assert components(len(values), [(at[x["u"]], at[x["v"]]) for x in found]) == components(len(values), pairs)


def test_sets_are_shuffled_once(spark, monkeypatch):
    """Texts of rows that aren't repeated go to their class's task only: no shuffle by digest before."""
    plans = []
    cut = common.cut
    monkeypatch.setattr(common, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:58] + [f"x{i}", "y"])) for i in range(9)], "doc_id long, text string")
    assert similar_texts.one_of_each(docs).count() == 1
    told = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(told) == 1 and "shingles" in told[0] and "first(shingles" not in told[0]


@pytest.mark.parametrize("listed", [100_000, 0])
def test_past_shuffles_go_before_texts_are_shuffled(spark, monkeypatch, listed):
    """What finding the classes shuffled is not on disk any more when all texts are."""
    monkeypatch.setattr(similar_texts, "BROADCAST_TEXTS", listed)

    def shuffles() -> set:
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_(\d+)_", files))

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:58] + [f"x{i % 9}", "y"])) for i in range(18)], "doc_id long, text string")
    before = max(map(int, shuffles()), default=-1)
    found = similar_texts.one_of_each(docs)
    until = time.time() + 20  # the cleaner works beside the driver's own thread
    while (left := {x for x in shuffles() if int(x) > before}) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert [r["doc_id"] for r in found.collect()] == [0]


def test_repeated_rows_cost_no_second_shuffle_of_texts(spark, monkeypatch, tmp_path):
    """Beyond the broadcast list, rows that are repeated and those that aren't are picked from one shuffle of texts."""
    monkeypatch.setattr(similar_texts, "BROADCAST_TEXTS", 0)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:58] + [f"x{i}", "y"])) for i in range(9)]
    spark.createDataFrame(rows + rows[:1] * 2, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    plans, cut = [], common.cut

    def kept(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return done

    monkeypatch.setattr(common, "cut", kept)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert similar_texts.one_of_each(spark.read.parquet(str(tmp_path / "docs"))).count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    told = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(told) == 1 and told[0].count("FileScan") == 1


def test_linked_sets_are_all_found():
    r = np.random.default_rng(12)
    for _ in range(60):
        core = r.choice(10**6, int(r.integers(1, 60)), replace=False)
        sets = [np.unique(np.concatenate((r.choice(core, int(r.integers(1, len(core) + 1)), replace=False), r.choice(10**6, int(r.integers(0, 8)))))).astype(np.uint64) for _ in range(40)]
        pairs = [(a, b) for b in range(40) for a in range(b) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8]
        assert components(40, similar_texts.linked(sets, 0.8)) == components(40, pairs)


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_components_of_paths_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (900, 901), (901, 900)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{500 + i: 500 for i in range(60)}, 900: 900, 901: 900}


def test_bpe_columns_for_ids_and_text(spark, small):
    docs = spark.createDataFrame([(1, "héllo wörld", 7), (2, None, 8)], "doc_id long, text string, ids_ int")
    coded = bpe.with_text(bpe.with_ids(docs, *bpe.vocabulary()), *bpe.vocabulary())
    assert coded.columns == ["doc_id", "text", "ids_", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in coded.collect()} == {1: "héllo wörld", 2: ""}
