"""Embedding of texts by a pluggable model; the default is a hashing stand-in, not a language model."""

from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 384
BATCH = 32


def hashing_model() -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of lower-case words, to unit length: deterministic and offline, for tests and as a placeholder."""
    import re

    import numpy as np
    from xxhash import xxh64_intdigest

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), SIZE))
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = xxh64_intdigest(word.encode())
                out[i, h % SIZE] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def embedder(model: Callable[[], Callable[[list[str]], list[list[float]]]] = hashing_model, batch: int = BATCH):
    """A Column function. `model` is called once in each task; what it returns gets lists of at most `batch` texts."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for texts in batches:
            filled = texts.fillna("").tolist()
            found: list = []
            for at in range(0, len(filled), batch):
                found += own(filled[at : at + batch])
            yield pd.Series(found)

    return embed


def embed_missing(chunks: DataFrame, embeddings: DataFrame, text: str | Column, model=hashing_model) -> DataFrame:
    """(chunk_id, vector) for chunks that have no embedding yet."""
    from ctxspark.sources.store import without_embeddings

    missing = without_embeddings(chunks, embeddings)
    return missing.select(F.col("id").alias("chunk_id"), embedder(model)(F.col(text) if isinstance(text, str) else text).alias("vector"))


def _on_worker(path: str) -> str:
    """A file where it is on this machine, or shipped with `SparkContext.addFile`."""
    import os

    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def onnx_model(model: str, tokenizer: str, most_tokens: int = 256) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A sentence encoder in ONNX form with its tokenizer file: token vectors are averaged over the text's tokens and brought to unit length.

    The files are loaded once in each task, from a path that is there on every machine or from what `addFile` shipped. Texts are cut
    after `most_tokens` tokens, as such models ask for. A text without tokens has the zero vector.
    """

    def load():
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark has a task for each core
        session = onnxruntime.InferenceSession(_on_worker(model), options, providers=["CPUExecutionProvider"])
        pieces = Tokenizer.from_file(_on_worker(tokenizer))
        pieces.enable_truncation(most_tokens)
        pieces.enable_padding()
        wanted = {x.name for x in session.get_inputs()}

        def embed(texts: list[str]) -> list[list[float]]:
            found = pieces.encode_batch(texts)
            ids, mask = (np.array([getattr(x, name) for x in found], np.int64).reshape(len(found), -1) for name in ("ids", "attention_mask"))
            feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            if not ids.size:
                return [[0.0] * (session.get_outputs()[0].shape[-1] or 0) for _ in texts]
            vectors = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
            mean = (vectors * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
            norms = np.linalg.norm(mean, axis=1, keepdims=True)
            return (mean / np.where(norms > 0, norms, 1)).tolist()

        return embed

    return load
