"""Temperature mixing of sources, in DataFrame and SQL functions only.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected between 0 (all alike) and 1 (as found): the
flattest mix that meets a target entropy, a limit on repetitions, or both (then the larger alpha). Without a budget, the
budget is the least at which every document is seen once at least, so nothing is dropped.

A source's budget of tokens is so many whole passes and a part of one more. Each pass is a permutation by a digest of pass and
doc_id, in 65,536 blocks; the part is the permutation's beginning, up to the last document that fits. Where it ends is
found block by block (three levels of 256 sums, then the few documents of the last block), so no window ever holds a
source, hot or not. Documents then only compare their digest with their source's end: texts are not shuffled.

Defined results: null source is a source of its own; null or empty text has no tokens, and documents of a source without
tokens are seen once; equal doc_ids of one source have one place in a permutation, and come in together or not at all; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm import common

SEED = "mix"
STEPS = 40
#: Sources up to which their plan is broadcast; its rows are under 200 bytes.
BROADCAST_SOURCES = 100_000
MAX_PASSES = 2.0


def n_tokens(text: str = "text") -> Column:
    """Tokens are words here: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def digest(key: Column, number: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), number.cast("string"), key, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def weights(sums: DataFrame, max_passes: float | None = None, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """sums (key, tokens) with weight, and budget in tokens. The sources' sums stand in one row while alpha is bisected.

    target_entropy is a share of the largest possible, from 0 to 1.
    """
    row = sums.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    total = "aggregate(transform(t, x -> pow(x, {a})), 0D, (s, x) -> s + x)"
    if budget is None:
        passes = "pow(array_max(t) / array_min(t), 1 - {a})"
    else:
        passes = f"{float(budget)!r} * array_max(transform(t, x -> pow(x, {{a}} - 1))) / {total}"
    entropy = f"(ln({total}) - {{a}} * aggregate(transform(t, x -> pow(x, {{a}}) * ln(x)), 0D, (s, x) -> s + x) / {total})"
    rules = []
    if max_passes is not None:
        rules.append(f"{passes} <= {float(max_passes)!r}")  # holds above some alpha
    if target_entropy is not None:
        rules.append(f"{entropy} <= {float(target_entropy)!r} * ln(size(t))")
    holds = " and ".join(f"({r})" for r in rules) or "true"
    middle = "((r.lo + r.hi) / 2)"
    bisected = (
        f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (r, i) -> if({holds.format(a=middle)},"
        f" named_struct('lo', r.lo, 'hi', {middle}), named_struct('lo', {middle}, 'hi', r.hi)))"
    )
    alpha = f"if(size(t) = 0, 1D, if({holds.format(a='0D')}, 0D, round({bisected}.hi, 9)))"
    fitted = row.select(F.expr(alpha).alias("alpha"), "t").withColumn("total", F.expr(total.format(a="alpha")))
    whole = "array_max(t) * total / pow(array_max(t), alpha)" if budget is None else f"{float(budget)!r}"
    fitted = fitted.withColumn("budget", F.expr(whole)).drop("t")
    # fitted is one row
    return sums.join(F.broadcast(fitted)).select(
        "key", "tokens", "alpha",
        F.expr("if(tokens > 0, pow(cast(tokens as double), alpha) / total, 0D)").alias("weight"),
        F.expr("if(tokens > 0, cast(floor(pow(cast(tokens as double), alpha) / total * budget + 0.5D) as bigint), 0L)").alias("goal"),
    )


def plan(sized: DataFrame, **target) -> tuple[DataFrame, int]:
    """sized (key, doc_id, n_tokens) -> per source: key, tokens, alpha, weight, goal, passes (whole), last (digest up to which one more)."""
    sums = sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
    sources = common.cut(
        weights(sums, **target).withColumns(
            {
                "passes": F.expr("if(tokens > 0, cast(goal div tokens as int), 1)"),
                "need": F.expr("if(tokens > 0, goal % tokens, 0L)"),
            }
        )
    )
    rows = sources.count()
    at = sources.where("need > 0").select("key", "passes", "need", F.lit("").alias("prefix"))
    for level in range(4):
        near = sized.join(_small(at, rows), "key").withColumn("digest", digest(F.col("key"), F.col("passes"), "doc_id"))
        near = near.where(F.col("digest").startswith(F.col("prefix")))
        if level == 3:
            order = Window.partitionBy("key").orderBy("digest").rangeBetween(Window.unboundedPreceding, 0)
            fits = near.withColumn("sum", F.sum("n_tokens").over(order)).where("sum <= need")
            ends = fits.groupBy("key").agg(F.max("digest").alias("last"))
            at = at.select("key", "prefix").join(ends, "key", "left").select("key", F.coalesce("last", "prefix").alias("last"))
            break
        blocks = near.groupBy("key", "passes", "need", "prefix", F.substring("digest", 2 * level + 1, 2).alias("d")).agg(
            F.sum("n_tokens").alias("t")
        )
        order = Window.partitionBy("key").orderBy("d")
        blocks = blocks.withColumn("sum", F.sum("t").over(order)).where("sum > need")
        first = blocks.groupBy("key", "passes", "need", "prefix").agg(F.min(F.struct("d", "sum", "t")).alias("b"))
        at = common.cut(
            first.select("key", "passes", (F.col("need") - F.col("b.sum") + F.col("b.t")).alias("need"), F.concat("prefix", "b.d").alias("prefix"))
        )
    return common.cut(sources.drop("need").join(at, "key", "left").withColumn("last", F.coalesce("last", F.lit("")))), rows


def mixed(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", out: str = "mix", **target) -> DataFrame:
    """docs, each row so often as its source's plan has it, with a struct: n_tokens, pass (from 0), block, weight."""
    target = target or {"max_passes": MAX_PASSES}
    sized = common.cut(docs.select(source_key(source).alias("key"), F.col(doc_id).alias("doc_id"), n_tokens(text).alias("n_tokens")))
    sources, rows = plan(sized, **target)
    key, own = f"__{out}_key", f"__{out}_plan"
    right = sources.select(
        F.concat("key", F.lit("")).alias(key), F.struct("passes", "last", "weight").alias(own)
    )
    left = docs.join(_small(right, rows), source_key(source) == F.col(key))
    more = digest(F.col(key), F.col(f"{own}.passes"), doc_id) <= F.col(f"{own}.last")
    n = F.col(f"{own}.passes") + more.cast("int")
    number = f"__{out}_pass"
    seen = left.where(n > 0).withColumn(number, F.explode(F.sequence(F.lit(0), n - 1)))
    block = F.conv(F.substring(digest(F.col(key), F.col(number), doc_id), 1, 4), 16, 10).cast("int")
    return seen.withColumn(
        out, F.struct(n_tokens(text).alias("n_tokens"), F.col(number).alias("pass"), block.alias("block"), F.col(f"{own}.weight").alias("weight"))
    ).drop(key, own, number)


def op3_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixed(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_passes=MAX_PASSES)
    return found.select("doc_id", "source", "mix.n_tokens", "mix.pass", "mix.block", F.round("mix.weight", 9).alias("weight"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
s AS (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY key),
r AS (SELECT max(tokens)::DOUBLE / min(tokens) AS ratio, max(tokens)::DOUBLE AS top FROM s WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= {MAX_PASSES} THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= {MAX_PASSES} THEN (lo + hi) / 2 ELSE hi END
  FROM b, r WHERE i < {STEPS}),
a AS (SELECT CASE WHEN ratio <= {MAX_PASSES} THEN 0::DOUBLE ELSE round(hi, 9) END AS alpha, top FROM b, r WHERE i = {STEPS}),
t AS (SELECT sum(pow(tokens::DOUBLE, alpha)) AS total FROM s, a WHERE tokens > 0),
p AS (
  SELECT key, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, alpha) / total ELSE 0 END AS weight,
         CASE WHEN tokens > 0 THEN floor(pow(tokens::DOUBLE, alpha) / total * (top * total / pow(top, alpha)) + 0.5)::BIGINT ELSE 0 END AS goal
  FROM s, a, t),
q AS (
  SELECT key, weight, CASE WHEN tokens > 0 THEN goal // tokens ELSE 1 END AS passes,
         CASE WHEN tokens > 0 THEN goal % tokens ELSE 0 END AS need FROM p),
f AS (
  SELECT d.*, weight, passes, need,
         sum(n_tokens) OVER (PARTITION BY key ORDER BY md5('{SEED}:' || passes || ':' || key || ':' || coalesce(doc_id::VARCHAR, ''))
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sum
  FROM d JOIN q USING (key)),
e AS (SELECT *, unnest(range(passes + CASE WHEN need > 0 AND sum <= need THEN 1 ELSE 0 END)) AS pass FROM f)
SELECT doc_id, source, n_tokens, pass::INTEGER AS pass,
       ('0x' || md5('{SEED}:' || pass || ':' || key || ':' || coalesce(doc_id::VARCHAR, ''))[1:4])::INTEGER AS block,
       round(weight, 9) AS weight
FROM e
"""
