"""An encoder from files: a model of one layer, written out by hand, against the same sums in numpy; an index that uses it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.operators import embed
from ctxspark.plans.index import Index

WORDS = ["[PAD]", "[UNK]", "alpha", "beta", "gamma", "login", "user"]
TABLE = np.random.default_rng(1).normal(size=(len(WORDS), 8)).astype(np.float32)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def data(field, content):
    content = content.encode() if isinstance(content, str) else content
    return varint(field << 3 | 2) + varint(len(content)) + content


def value(name, kind, shape):
    dims = b"".join(data(1, number(1, d) if isinstance(d, int) else data(2, d)) for d in shape)
    return data(1, name) + data(2, data(1, number(1, kind) + data(2, dims)))


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """(model, tokenizer): one Gather of token vectors."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    folder = tmp_path_factory.mktemp("model")
    table = number(1, TABLE.shape[0]) + number(1, TABLE.shape[1]) + number(2, 1) + data(8, "table") + data(9, TABLE.tobytes())
    node = data(1, "table") + data(1, "input_ids") + data(2, "hidden") + data(4, "Gather")
    graph = data(1, node) + data(2, "g") + data(5, table) + data(11, value("input_ids", 7, ["b", "t"])) + data(12, value("hidden", 1, ["b", "t", 8]))
    (folder / "m.onnx").write_bytes(number(1, 8) + data(7, graph) + data(8, number(2, 13)))
    own = Tokenizer(models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    own.normalizer, own.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    own.save(str(folder / "t.json"))
    return str(folder / "m.onnx"), str(folder / "t.json")


def by_hand(text, most=256):
    ids = [WORDS.index(w) if w in WORDS else 1 for w in text.lower().split()][:most]
    mean = TABLE[ids].mean(axis=0) if ids else np.zeros(8)
    return mean / (np.linalg.norm(mean) or 1)


def test_onnx_model(spark, model):
    texts = ["alpha beta", "Gamma", "", "other words alpha alpha", "login " * 400, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(2)
    found = {r["i"]: r["v"] for r in rows.select("i", embed.embedder(embed.onnx_model(*model), batch=2)("text").alias("v")).collect()}
    for i, text in enumerate(texts):
        assert np.allclose(found[i], by_hand(text or ""), atol=1e-6)
    cut = embed.onnx_model(*model, most_tokens=2)()(["alpha beta gamma", "user"])
    assert np.allclose(cut, [by_hand("alpha beta gamma", 2), by_hand("user")], atol=1e-6)
    assert np.allclose(embed.onnx_model(*model)()([""]), np.zeros(8))


def test_index_with_a_model(spark, model, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export function loginUser(x) { return 1; }\nexport function alpha(beta) { return 2; }\n")
    index = Index(spark, str(tmp_path), model=embed.onnx_model(*model))
    index.build()
    vectors = {r["chunk_id"].split("#")[1]: r["vector"] for r in index.store.table("embeddings").collect()}
    summaries = {r["name"]: r["summary"] for r in index.store.table("chunks").collect()}
    assert all(np.allclose(vectors[n], by_hand(s.replace("(", " ( ").replace(")", " ) ").replace(".", " . ")), atol=1e-6) for n, s in summaries.items())
    assert index.search("login user", use_git=False).select(F.first("name")).first()[0] == "loginUser"
