"""Token counts: greedy word-piece lengths by a linear longest-match automaton, without building pieces.

The vocabulary's trie has two roots, for the beginning of a word and for its continuation. Every node has a failure link, to where
matching goes on after the longest pieces of what was read are popped, and the number of pieces popped on the way. A word then
takes one step a byte (amortised), whatever the vocabulary.

Defined results: words are runs of anything but ASCII white space; null text counts as empty and has no tokens; a word that can't be cut
into pieces is one unknown token; a very long text is split whole, its words held at once; repeated rows come out as often as they came in; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import common
from ctxspark.llm.bpe import read_ranks

#: Words whose counts a worker keeps.
MAX_WORDS = 400_000
COUNTS = common.struct("n_words long, n_tokens long, n_unknown long")


class Automaton:
    def __init__(self, initial: set[bytes], continuing: set[bytes]) -> None:
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        ends = [False, False]
        order = []  # (parent, byte, node), parents first after sorting by depth
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for depth, byte in enumerate(piece):
                    after = self.child.get(node << 8 | byte)
                    if after is None:
                        after = self.child[node << 8 | byte] = len(ends)
                        ends.append(False)
                        order.append((depth, node, byte, after))
                    node = after
                ends[node] = node > 1
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        for _, parent, byte, node in sorted(order):
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.child:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.child[at << 8 | byte], n
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it can't be cut into pieces."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for byte in word:
            after = child.get(at << 8 | byte)
            while after is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                after = child.get(at << 8 | byte)
            at = after
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n

    def counts(self, text: bytes) -> tuple[int, int, int]:
        words, known = text.split(), self.known
        tokens = unknown = 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(word) <= 64:
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    known[word] = n
            if n:
                tokens += n
            else:
                unknown += 1
        return len(words), tokens + unknown, unknown


def pieces(ranks: dict[bytes, int]) -> tuple[set[bytes], set[bytes]]:
    """Word-piece sets from byte-level tokens: tokens after a space start words, tokens without white space continue them; a
    single byte may do either, so that every word can be cut."""
    bare = {t for t in ranks if t.split() == [t]}
    return {t[1:] for t in ranks if t[:1] == b" " and t.split() == [t[1:]]} | {t for t in bare if len(t) == 1}, bare


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """One in each worker."""
    return Automaton(*pieces(read_ranks(path)))


def _counter(path: str):
    @F.arrow_udf(COUNTS)
    def count(text):
        import pyarrow as pa

        own = automaton(path)
        columns = list(zip(*map(own.counts, common.texts(text)))) or [[]] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS.names)

    return count


def with_token_counts(docs: DataFrame, path: str, out: str = "tokens", text: str = "text") -> DataFrame:
    """docs with a struct: n_words, n_tokens, n_unknown."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _counter(path)(F.col(text).cast("string")))


def op1_linear_longest_match(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_token_counts(docs, common.tokenizer_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "tokens.n_words", "tokens.n_tokens", "tokens.n_unknown")
