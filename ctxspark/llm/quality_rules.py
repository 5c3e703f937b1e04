"""Quality rules, judged by host.

Every text gets counts and rule failures. The base rule (too short, or repetitive) rejects by itself. Of the texts that pass it, failures
of the other rules are summed by host (`source`); a host's rate for a rule is shrunk towards the corpus rate of that rule by a beta prior
fitted to the hosts (method of moments): (fails + s * mean) / (n + s), where s = mean * (1 - mean) / variance - 1, from 1 to 1000. A host is bad
for a rule if its rate is above the rule's corpus rate with a posterior probability of more than `CERTAINTY`: the shrunk rate exceeds it by
`DEVIATIONS` standard deviations of the posterior, sqrt(rate * (1 - rate) / (n + s + 1)), the beta posterior taken as normal. Where the whole
corpus is bad no host stands out, so a host with a shrunk rate of `MOST` or more is bad too. The verdict goes back to the host's documents: those that
break the rule there are rejected, while the same document is kept on a host that isn't bad for it. Documents that break no rule are kept
everywhere. Small hosts stand near the corpus rate, with a wide posterior, and are left alone.

Sums are partial before the shuffle. Verdicts are broadcast up to a checked number of hosts, else joined on a key that adaptive execution
may split, so a host with a third of all rows is no hot task.

Defined results: null text counts as empty (no words, base_failed); null hosts are one host of their own; a very long text is counted whole, with
its windows as numbers, some 100 bytes a word; repeated rows each count and come out as often as they came in; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm import common

#: Rules that count against a host: symbols per word, share of repeated lines, mean word length.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES = 0.3
WORD_LENGTHS = (2.5, 14.0)
#: A host is bad for a rule if its rate is above the corpus rate with this probability (that many standard deviations), or is this high.
CERTAINTY, DEVIATIONS = 0.8, 0.8416
MOST = 0.5
#: Words of a text from which on its windows are counted as numbers.
MANY_WORDS = 100_000
#: Hosts up to which their verdicts are broadcast; beyond that they are joined.
BROADCAST_HOSTS = 100_000
RULES = ("symbols", "lines", "length")

COUNTS = common.struct("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def _repeat_words_of_many(words: list[bytes]) -> int:
    """The same for very long texts: windows are numbered step by step, equal ones alike."""
    import numpy as np

    known: dict[bytes, int] = {}
    each = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    window = each
    for step in range(1, 5):
        _, window = np.unique(window[:-1] * len(known) + each[step:], return_inverse=True)
    at = np.flatnonzero(np.bincount(window)[window] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeat_words(words: list[bytes]) -> int:
    """Words within five-word windows that occur twice or more."""
    if len(words) > MANY_WORDS:
        return _repeat_words_of_many(words)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered = Counter(grams), bytearray(len(words))
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered[i : i + 5] = b"\x01\x01\x01\x01\x01"
    return sum(covered)


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    bare = text.translate(None, SPACES)
    # code points: all bytes but continuation bytes
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def _counts(text):
    import pyarrow as pa

    common.make_room(__name__)
    columns = list(zip(*map(counts, common.texts(text)))) or [[]] * len(COUNTS)
    common.release()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS.names)


# else a filter over the counts would be pushed below the call and run it once more
_counts = F.arrow_udf(_counts, COUNTS).asNondeterministic()


def with_counts(docs: DataFrame, out: str = "quality", text: str = "text") -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _counts(F.col(text).cast("string")))


def failures(quality: str = "quality") -> dict:
    """Rule -> boolean column over the counts."""
    q = lambda name: F.col(f"{quality}.{name}")
    words = q("n_words")
    return {
        "base": (words < 10) | (100 * q("n_repeat_words") > 20 * words),
        "symbols": q("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
        "lines": q("n_dup_lines") > MAX_DUP_LINES * q("n_lines"),
        "length": (q("word_chars") < WORD_LENGTHS[0] * words) | (q("word_chars") > WORD_LENGTHS[1] * words),
    }


def host_key(host: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-"))


def host_verdicts(counted: DataFrame, host: str = "source", quality: str = "quality") -> DataFrame:
    """One row per host: host_key, n_docs, n_judged (those that pass the base rule), and per rule rate_ (shrunk) and bad_."""
    failed = failures(quality)
    passed = ~failed["base"]
    sums = counted.groupBy(host_key(host).alias("host_key")).agg(
        F.count("*").alias("n_docs"), F.count_if(passed).alias("n_judged"), *[F.count_if(passed & failed[r]).alias(f"fails_{r}") for r in RULES]
    )
    judged = F.nullif(F.col("n_judged"), F.lit(0))
    all_judged = F.nullif(F.sum("n_judged"), F.lit(0))
    prior = sums.agg(
        *[(F.sum(f"fails_{r}") / all_judged).alias(f"mean_{r}") for r in RULES],
        *[F.var_pop(F.col(f"fails_{r}") / judged).alias(f"var_{r}") for r in RULES],
    )
    for r in RULES:
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        # hosts that don't differ at all say nothing against the corpus rate
        strength = F.when(var > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / var - 1))).otherwise(1000.0)
        prior = prior.withColumn(f"strength_{r}", strength)
    # the prior is one row
    shrunk = sums.join(F.broadcast(prior))
    for r in RULES:
        n, mean, strength = F.col("n_judged"), F.col(f"mean_{r}"), F.col(f"strength_{r}")
        shrunk = shrunk.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + strength * mean) / (n + strength))
        rate = F.col(f"rate_{r}")
        over = (rate - mean > DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + strength + 1))) | (rate >= MOST)
        shrunk = shrunk.withColumn(f"bad_{r}", F.coalesce(over, F.lit(False)))
    return shrunk.select("host_key", "n_docs", "n_judged", *[f"rate_{r}" for r in RULES], *[f"bad_{r}" for r in RULES])


def judge(counted: DataFrame, hosts: DataFrame, host: str = "source", quality: str = "quality", out: str = "verdict") -> DataFrame:
    """counted with a struct: base_failed, kept."""
    failed = failures(quality)
    right = common.checked_broadcast(
        hosts.select(F.concat("host_key", F.lit("")).alias(f"{out}_host"), F.struct(*[f"bad_{r}" for r in RULES]).alias(f"{out}_bad")),
        BROADCAST_HOSTS,
    )
    joined = counted.join(right, host_key(host) == F.col(f"{out}_host"), "left")
    rejected = failed["base"]
    for r in RULES:
        rejected = rejected | (failed[r] & F.col(f"{out}_bad.bad_{r}"))
    verdict = F.struct(failed["base"].alias("base_failed"), F.coalesce(~rejected, F.lit(False)).alias("kept"))
    return joined.withColumn(out, verdict).drop(f"{out}_host", f"{out}_bad")


def op5_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = common.cut(with_counts(docs).drop("text"))
    found = judge(counted, host_verdicts(counted))
    return found.select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        "verdict.base_failed", "verdict.kept",
    )


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT rid, i, words[i:i+4] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(5)) AS j) GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, host, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS f_base, n_symbols > 0.1::DOUBLE * n_words AS f_symbols,
         n_dup_lines > 0.3::DOUBLE * n_lines AS f_lines,
         (word_chars < 2.5::DOUBLE * n_words OR word_chars > 14.0::DOUBLE * n_words) AS f_length FROM base),
h AS (
  SELECT host, count(*) FILTER (NOT f_base) AS n, count(*) FILTER (NOT f_base AND f_symbols) AS k_symbols,
         count(*) FILTER (NOT f_base AND f_lines) AS k_lines, count(*) FILTER (NOT f_base AND f_length) AS k_length FROM f GROUP BY host),
long AS (UNPIVOT h ON k_symbols, k_lines, k_length INTO NAME rule VALUE k),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(1, least(1000, m * (1 - m) / v - 1)) ELSE 1000 END AS s
  FROM (SELECT rule, sum(k)::DOUBLE / nullif(sum(n), 0) AS m, var_pop(k::DOUBLE / nullif(n, 0)) AS v FROM long GROUP BY rule)),
bad AS (
  SELECT host, max(b) FILTER (rule = 'k_symbols') AS b_symbols, max(b) FILTER (rule = 'k_lines') AS b_lines, max(b) FILTER (rule = 'k_length') AS b_length
  FROM (
    SELECT host, rule, coalesce(r - m > 0.8416::DOUBLE * sqrt(r * (1 - r) / (n + s + 1)) OR r >= 0.5::DOUBLE, false) AS b
    FROM (SELECT *, (k + s * m) / (n + s) AS r FROM long JOIN prior USING (rule))) GROUP BY host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, f_base AS base_failed,
       NOT (f_base OR (f_symbols AND b_symbols) OR (f_lines AND b_lines) OR (f_length AND b_length)) AS kept
FROM f JOIN bad USING (host)
"""
