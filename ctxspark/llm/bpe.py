"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

The encoding of a prefix ends in the one token t for which the encoding of the rest ends in a token that stays apart
from t when both are merged together. A state of the transducer is what can still matter: the pending bytes (the longest
suffix that a longer token could start with) and, for every live cut within them, the token that the encoding up to the cut
ends with. A transition says which token ends at its byte. Transitions and states are made when first met and kept up to a bound;
every pre-token that is no token itself goes through them. Tokens are sent once they are settled: all live cuts are within the
longest token, so the lookahead is bounded by where their encodings meet; a short piece is settled at its end, a long one is sent
from time to time, so that its length costs no memory but its own.

Defined results: null text counts as empty, an empty text has no tokens; white space and unknown bytes are text like any
other; repeated rows come out as often as they came in; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from ctxspark.llm import common

#: States and transitions that a worker keeps; beyond either, the tables start again from the state reached.
MAX_STATES = 200_000
MAX_STEPS = 500_000
MAX_PAIRS = 300_000
MAX_PIECES = 300_000
MAX_UNITS = 200_000
#: Bytes after which a long piece's settled tokens are sent.
LOOK = 4096
#: Pieces that a worker keeps from one task to the next: those met first, which are the common ones.
KEPT_PIECES = 120_000
NONE = 1 << 40
#: Bits of a token id in a transition.
ID_BITS = 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Key of what a node is, beside its arcs by byte.
OWN = -1


class Transducer:
    """Encodes one pre-token, byte by byte.

    A node stands for pending bytes: byte -> (tokens that may end there, cuts that stay live, next node), its bytes and live cuts
    under OWN. A state is a node with the token that ends at each of its live cuts. `steps` has the transitions, state and byte -> next
    state and the token that ends there; both are numbers, so that the table is one flat dictionary.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import struct

        if max(ranks.values()) >> ID_BITS:
            raise ValueError("token ids need more bits")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.packed = {i: struct.pack("<I", i) for i in self.tokens}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.apart: dict[int, bool] = {}
        self.nodes: dict[bytes, dict] = {}
        self.root = self._node(b"")
        #: Transitions made since the worker started; tests hold it against the pieces encoded.
        self.made = 0
        self._reset()

    def _reset(self) -> None:
        self.steps: dict[int, int] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._state(self.root, (-1,))

    def _node(self, pending: bytes) -> dict:
        node = self.nodes.get(pending)
        if node is None:
            live = [i for i in range(len(pending)) if pending[i:] in self.prefixes] + [len(pending)]
            node = self.nodes[pending] = {OWN: (pending, live)}
        return node

    def _arc(self, node: dict, byte: int) -> tuple:
        """A cut is live while what follows it is the beginning of a longer token; cuts are named by their place among the live ones."""
        pending, live = node[OWN]
        text = pending + bytes((byte,))
        ends = [(k, self.ranks[text[i:]]) for k, i in enumerate(live) if text[i:] in self.ranks]
        keep = [k for k, i in enumerate(live) if text[i:] in self.prefixes]
        if not ends:
            raise ValueError("the vocabulary lacks a single byte")
        found = node[byte] = (ends, keep, self._node(text[live[keep[0]] :] if keep else b""))
        return found

    def _state(self, node: dict, lasts: tuple) -> int:
        """The state's number, 256 apart: a byte fits between."""
        key = (id(node), lasts)  # nodes stay
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states) << 8
            self.states.append((node, lasts))
        return number

    def merged(self, piece: bytes) -> list[int]:
        """The merges as they are defined: always the lowest rank, leftmost; for pairs of tokens, hence short."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
        return [self.ranks[p] for p in parts]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are what their bytes are merged to; left -1: none."""
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        if left < 0:
            known = self.merged(self.tokens[right]) == [right]
        else:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        self.apart[(left << 20) | right] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """Make the transition: the token that ends after this byte is the one that stays apart from what ends before it."""
        node, lasts = self.states[state >> 8]
        if len(self.states) >= MAX_STATES or len(self.steps) >= MAX_STEPS:
            self._reset()
            state = self._state(node, lasts)
        ends, keep, after = node[byte] if byte in node else self._arc(node, byte)
        apart = self.apart
        for k, token in ends:
            pair = (lasts[k] << 20) | token
            if apart[pair] if pair in apart else self.stay_apart(lasts[k], token):
                break
        else:
            raise ValueError("no token fits")
        new = self._state(after, (*[lasts[k] for k in keep], token))
        self.made += 1
        step = self.steps[state + byte] = (new << ID_BITS) | token
        return step

    def _settled(self, state: int, lasts: list[int]) -> int:
        """How many bytes all that is live has the same tokens for."""
        pending, live = self.states[state >> 8][0][OWN]
        ends = {len(lasts) - len(pending) + cut for cut in live}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.lengths[lasts[end - 1]])
        return ends.pop()

    def encode(self, piece: bytes) -> bytes:
        """The ids, as little-endian 32-bit numbers.

        Each byte yields the token that ends there; the way back from a settled end is the encoding.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(piece) <= LOOK:
            return self._back(self._walk(self.start, piece, [])[1])
        out, state, lasts = [], self.start, []
        for at in range(0, len(piece), LOOK):
            state, lasts = self._walk(state, piece[at : at + LOOK], lasts)
            settled = self._settled(state, lasts)
            out.append(self._back(lasts[:settled]))
            lasts = lasts[settled:]
        return b"".join(out) + self._back(lasts)

    def _walk(self, state: int, piece: bytes, lasts: list[int]) -> tuple[int, list[int]]:
        add, mask = lasts.append, (1 << ID_BITS) - 1
        for byte in piece:
            try:
                step = self.steps[state + byte]
            except KeyError:
                step = self._step(state, byte)
            add(step & mask)
            state = step >> ID_BITS
        return state, lasts

    def _back(self, lasts: list[int]) -> bytes:
        packed, lengths = self.packed, self.lengths
        at, out = len(lasts), []
        while at:
            token = lasts[at - 1]
            out.append(packed[token])
            at -= lengths[token]
        out.reverse()
        return b"".join(out)


class Pieces(dict):
    """Encoded pre-tokens as little-endian 32-bit ids; short ones are kept, up to a bound."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        packed = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 48:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def open_end(stretch: str) -> bool:
    """Whether how the stretch is split depends on what follows."""
    return not stretch or stretch[-1].isspace()


class Units(dict):
    """Encoded stretches of text from one space to the next, that space first; short ones are kept, up to a bound.

    Where a space follows anything but white space, a pre-token begins, so stretches may be split apart. A stretch that ends in white
    space is None here: how it is split depends on what follows.
    """

    def __init__(self, pieces: Pieces, split) -> None:
        self.pieces, self.split = pieces, split

    def __missing__(self, unit: str) -> bytes | None:
        if open_end(unit):
            packed = None
        else:
            pieces = self.pieces
            packed = b"".join([pieces[p] for p in self.split(" " + unit)])
        if len(unit) <= 32:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[unit] = packed
        return packed


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import public_tokenizers
        import regex

        self.split = regex.compile(pattern).findall
        ranks = read_ranks(path)
        self.pieces = Pieces(Transducer(ranks))
        # other patterns may match across a space
        self.units = Units(self.pieces, self.split) if pattern == public_tokenizers.PATTERN else None
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if self.units is None:
            return self._plain(whole)
        stretches, units = whole.split(" "), self.units
        coded = [units[u] for u in stretches]
        if stretches[0]:  # no space before the first
            coded[0] = None
        if None not in coded:
            return b"".join(coded)
        # stretches whose end is open go together with those that follow
        out, at, n = [], 0, len(stretches)
        while at < n:
            if coded[at] is not None:
                out.append(coded[at])
                at += 1
                continue
            end = at + 1
            while end < n and open_end(stretches[end - 1]):
                end += 1
            out.append(self._plain((" " if at else "") + " ".join(stretches[at:end])))
            at = end
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.split(text)])

    def trim(self) -> None:
        """Give memory back at the end of a task; workers outlive their tasks."""
        for kept, most in ((self.pieces, KEPT_PIECES), (self.units or {}, KEPT_PIECES // 4)):
            if len(kept) > most:
                first = list(islice(kept.items(), most))
                kept.clear()
                kept.update(first)

    def decode(self, packed: bytes, chunk: int = 1 << 16) -> str:
        import numpy as np

        ids, stream, table = np.frombuffer(packed, "<u4"), Utf8Stream(), self.table
        out = [stream.feed(b"".join([table[i] for i in ids[k : k + chunk].tolist()])) for k in range(0, len(ids), chunk)]
        return "".join(out) + stream.end()


class Utf8Stream:
    """Incremental UTF-8: bytes in, whole characters out; an unfinished character waits for its other bytes.

    The machine's state is how many continuation bytes are missing. It walks back over at most three bytes to find
    where the unfinished character starts; what lies before is complete. Broken bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def missing(lead: int) -> int:
        """Continuation bytes that a lead byte asks for."""
        return 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.missing(byte) >= back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@common.worker_cache
def codec(path: str, pattern: str) -> Codec:
    """One in each worker. Its tables are long-lived and would be searched for cycles again and again."""
    gc.freeze()
    gc.set_threshold(1_000_000, 50, 1000)
    return Codec(path, pattern)


def _encoder(path: str, pattern: str):
    def encode(batches):
        import pyarrow as pa

        own = codec(path, pattern)
        try:
            for text in batches:
                yield pa.array([own.encode(x) for x in common.texts(text)], pa.binary())
        finally:
            own.trim()
            common.release()

    # else the optimiser may put the call in place of its result, and run it once more for each use
    return F.arrow_udf(encode, T.BinaryType(), ArrowUDFType.SCALAR_ITER).asNondeterministic()


def _decoder(path: str, pattern: str):
    @F.arrow_udf(T.StringType())
    def decode(ids):
        import pyarrow as pa

        own = codec(path, pattern)
        return pa.array([own.decode(x or b"") for x in ids.to_pylist()], pa.string())

    return decode


CODED = common.struct("ids binary, decoded string")


def _round_tripper(path: str, pattern: str):
    def code(batches):
        import pyarrow as pa

        own = codec(path, pattern)
        try:
            for text in batches:
                ids = [own.encode(x) for x in common.texts(text)]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], names=CODED.names)
        finally:
            own.trim()
            common.release()

    return F.arrow_udf(code, CODED, ArrowUDFType.SCALAR_ITER)


def with_ids(docs: DataFrame, path: str, pattern: str, out: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text's token ids, packed as little-endian unsigned 32-bit integers."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _encoder(path, pattern)(F.col(text).cast("string")))


def with_text(docs: DataFrame, path: str, pattern: str, out: str = "decoded", ids: str = "ids") -> DataFrame:
    """docs with the text that packed ids stand for."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _decoder(path, pattern)(F.col(ids)))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return common.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def with_round_trip(docs: DataFrame, path: str, pattern: str, out: str = "coded", text: str = "text") -> DataFrame:
    """docs with a struct: ids (packed) and decoded (the text they stand for), both from one worker's tables."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _round_tripper(path, pattern)(F.col(text).cast("string")))


def round_trip(docs: DataFrame) -> DataFrame:
    coded = with_round_trip(docs.select("doc_id", "text"), *vocabulary())
    return coded.select(
        "doc_id",
        F.expr("octet_length(coded.ids) div 4").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("coded.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
