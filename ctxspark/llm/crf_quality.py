"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is labelled good or bad from its own and its neighbours' features; forward-backward marginals of `good`, weighted by the
lines' lengths, are averaged to the document's score. Training lines take their document's label. The field is fitted by Adam on at
most `TRAIN_DOCUMENTS` labelled documents (those with the smallest hashes of their id, whatever the table's size) and
`TRAIN_LINES` of their lines' features; all documents are scored whole.

Defined results: null text counts as empty; an empty text is one empty line and gets a score as well; labels that are null don't train, of several for one id the largest does;
without labels of both kinds every score is the share of good labels (1 if there are none); a very long text is
scored whole, with all its lines' features at once (some KB a line); repeated rows come out as often as they came in; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.llm import common

TRAIN_DOCUMENTS = 20_000
TRAIN_LINES = 400_000
EPOCHS = 24
THRESHOLD = 0.7

UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>@^~_=+\\{}[]"
MARKS, BARS, SHOUTS, SPACES = b".,;:?'\"()-", b"|", b"!", b" \t\x0b\x0c\r"
NON_ASCII = bytes(range(128, 256))
CLASSES = (UPPER, DIGITS, SYMBOLS, MARKS, BARS, SHOUTS, SPACES, NON_ASCII)
#: Features of a line by itself; see line_features().
N_OWN = len(CLASSES) + 11
N_ALL = 3 * N_OWN + 3


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    from math import log1p

    n = len(line)
    size = max(n, 1)
    words = line.split()
    k = max(len(words), 1)
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], words[2:])))
    longest = max(map(len, words), default=0)
    short = sum(1 for w in words if len(w) <= 3)
    again = float(line in seen and n > 0)
    seen.add(line)
    tail = line.rstrip()[-1:]
    return [
        *((n - len(line.translate(None, c))) / size for c in CLASSES),
        log1p(n), log1p(len(words)), (n - len(words)) / k / 10, min(longest, 60) / 20, short / k,
        kinds / k, pairs / max(len(words) - 2, 1) if len(words) > 2 else 1.0,
        float(tail in (b".", b"?", b'"')), float(line[:1].isupper()), again, float(not words),
    ]


def own_features(text: bytes):
    """Lines by features, and the lines' weights."""
    import numpy as np

    lines, seen = text.split(b"\n"), set()
    return np.array([line_features(x, seen) for x in lines], np.float32), np.array([len(x) + 1 for x in lines], np.float64)


def with_neighbours(own, lengths):
    """Own, previous and next line's features, whether there is one, and a constant; rows of several texts follow one another."""
    import numpy as np

    n = len(own)
    starts = np.cumsum(lengths) - lengths
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts] = True
    last[starts + lengths - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[last] = 0
    return np.concatenate((own, before, after, first[:, None], last[:, None], np.ones((n, 1))), axis=1, dtype=np.float32)


def _padded(lengths):
    """Groups of texts of like lengths: (texts, row numbers as texts x longest, mask)."""
    import numpy as np

    order = np.argsort(lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        end = at + 1
        while end < len(order) and end - at < 512 and lengths[order[end]] <= 1.25 * longest + 2:
            end += 1
        texts = order[at:end]
        longest = int(lengths[texts].max())
        steps = np.arange(longest)
        mask = steps < lengths[texts][:, None]
        yield texts, np.where(mask, starts[texts][:, None] + steps, 0), mask
        at = end


def forward_backward(scores, mask, moves):
    """scores (texts, steps) of `good`; moves (2, 2) log potentials. Marginals of good, and expected moves (2, 2)."""
    import numpy as np

    n, steps = scores.shape
    good = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    psi = np.stack((1 - good, good), axis=2)
    m = np.exp(moves)
    alpha, beta = np.empty((n, steps, 2)), np.ones((n, steps, 2))
    alpha[:, 0] = psi[:, 0]
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ m) * psi[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        right = psi[:, t + 1] * beta[:, t + 1]
        b = right @ m.T
        both = alpha[:, t, :, None] * m * right[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected += both[mask[:, t + 1]].sum(axis=0)
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    out = alpha * beta
    return (out / out.sum(axis=2, keepdims=True))[:, :, 1], expected


class Field:
    """Weights of the features for `good`, log potentials of moves between labels, and the features' scale."""

    def __init__(self, mean, scale, weights, moves, constant: float | None = None) -> None:
        self.mean, self.scale, self.weights, self.moves, self.constant = mean, scale, weights, moves, constant

    def scores(self, texts: list[bytes]):
        import numpy as np

        if self.constant is not None:
            return np.full(len(texts), self.constant)
        features = [own_features(x) for x in texts]
        lengths = np.array([len(f) for f, _ in features], np.int64)
        rows = ((with_neighbours(np.concatenate([f for f, _ in features]), lengths) - self.mean) / self.scale) @ self.weights
        out = np.empty(len(texts))
        for which, at, mask in _padded(lengths):
            marginals, _ = forward_backward(rows[at], mask, self.moves)
            for i, t in enumerate(which):
                weight = features[t][1]
                out[t] = (marginals[i, : len(weight)] * weight).sum() / weight.sum()
        return np.clip(out, 0.0, 1.0)


def fit(own: list, labels, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4) -> Field:
    """own: features of each text's lines; labels 0 or 1. Maximises the likelihood of all lines bearing their text's label."""
    import numpy as np

    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Field(None, None, None, None, constant=float(labels.mean()) if len(labels) else 1.0)
    lengths = np.array([len(x) for x in own], np.int64)
    rows = with_neighbours(np.concatenate(own), lengths)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[-1], scale = 0, np.where(scale > 1e-6, scale, 1)
    rows = (rows - mean) / scale
    weights, moves = np.zeros(rows.shape[1]), np.zeros((2, 2))
    params = [weights, moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    groups, step, random = list(_padded(lengths)), 0, np.random.default_rng(7)
    for epoch in range(epochs):
        for g in random.permutation(len(groups)):
            which, at, mask = groups[g]
            x, y = rows[at], labels[which]
            marginals, expected = forward_backward(x @ weights, mask, moves)
            gap = (y[:, None] - marginals) * mask
            n = mask.sum()
            grad = np.einsum("ts,tsf->f", gap, x) / n - decay * weights
            seen = np.zeros((2, 2))
            pairs = mask[:, 1:].sum(axis=1)
            seen[1, 1], seen[0, 0] = pairs[y == 1].sum(), pairs[y == 0].sum()
            step += 1
            for p, d, a, b in zip(params, (grad, (seen - expected) / n - decay * moves), first, second):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p += rate / (1 + epoch / 8) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, weights, moves)


@F.arrow_udf(T.BinaryType())
def _packed_features(text):
    import pyarrow as pa

    return pa.array([own_features(x)[0].tobytes() for x in common.texts(text)], pa.binary())


def train(docs: DataFrame, labels: DataFrame, training, most: int = TRAIN_DOCUMENTS, most_lines: int = TRAIN_LINES) -> Field:
    """docs (doc_id, text), labels (doc_id, label): a bounded sample of labelled documents goes to the driver."""
    import numpy as np

    common.bounded_batches(docs.sparkSession)
    known = labels.where(training & F.col("label").isin(0, 1)).select("doc_id", "label").groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most `most` rows
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "label"))
    sample = docs.join(chosen, F.col("doc_id") == F.col("id")).select("id", "label", _packed_features(F.col("text")).alias("f"))
    # whole documents; one whose lines don't fit any more is passed over
    sizes = sample.select("id", "label", "f").withColumn("lines", F.octet_length("f") / (4 * N_OWN))
    sizes = sizes.withColumn("f", F.when(F.col("lines") <= most_lines, F.col("f")))
    own, marks, lines = [], [], 0
    for row in sizes.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        if len(own) >= most or lines >= most_lines:
            break
        if lines + row["lines"] > most_lines:
            continue
        lines += row["lines"]
        own.append(np.frombuffer(bytes(row["f"]), np.float32).reshape(-1, N_OWN))
        marks.append(row["label"])
    return fit(own, marks)


def _scorer(field):
    @F.arrow_udf(T.DoubleType())
    def score(text):
        import numpy as np
        import pyarrow as pa

        found, held, size = [np.zeros(0)], [], 0
        for x in common.texts(text):
            if held and size + len(x) > 4 << 20:
                found.append(field.value.scores(held))
                held, size = [], 0
            held.append(x)
            size += len(x)
        if held:
            found.append(field.value.scores(held))
        return pa.array(np.concatenate(found))

    return score


def with_score(docs: DataFrame, field: Field, out: str = "score", text: str = "text") -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.withColumn(out, _scorer(shared)(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def op8_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    field = train(docs, labels, common.fold("doc_id", 4) != 2)
    found = with_score(docs, field)
    return found.select(
        "doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
