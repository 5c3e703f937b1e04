"""Token budgets: model table, prefix packing, greedy packing, truncation.

Prefix packing is a running sum over an order; it runs on top-k lists of tens of rows, so one ordered window is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.text import estimate_tokens

# Budgets by the first name that the model's name contains, in this order.
MODEL_BUDGETS = [
    ("gpt-4", 6000), ("gpt-4o", 8000), ("gpt-4o-mini", 4000), ("gpt-4-turbo", 8000), ("gpt-3.5-turbo", 3000),
    ("o1", 8000), ("o1-mini", 4000), ("o3", 10000), ("o3-mini", 6000),
    ("claude-3-opus", 10000), ("claude-3-sonnet", 8000), ("claude-3-haiku", 4000), ("claude-3.5-sonnet", 10000),
    ("claude-4-opus", 12000), ("claude-4-sonnet", 10000),
    ("gemini-pro", 6000), ("gemini-1.5-pro", 10000), ("gemini-2", 10000),
    ("llama-3-8b", 2000), ("llama-3-70b", 4000), ("llama-3.1-405b", 6000), ("mistral-7b", 2000), ("mixtral", 4000),
    ("codellama-34b", 3000), ("deepseek-coder", 4000), ("deepseek-v2", 6000), ("qwen-2.5-coder", 4000), ("phi-3", 2000), ("starcoder2", 3000),
]
DEFAULT_BUDGET = 4000
AUTO_BUDGET = 2000
TRUNCATION_RESERVE = 5
GRAPH_BOOST = 1.5


def model_budget(model: str | Column) -> Column:
    low = F.lower(F.col(model) if isinstance(model, str) else model)
    out = None
    for name, budget in MODEL_BUDGETS:
        out = F.when(low.contains(name), budget) if out is None else out.when(low.contains(name), budget)
    return out.otherwise(DEFAULT_BUDGET)


def token_budget(model: str | None) -> int:
    low = (model or "").lower()
    return next((budget for name, budget in MODEL_BUDGETS if name in low), DEFAULT_BUDGET)


def prefix(entries: DataFrame, cost: str, budget: float, order: list, spent: float | Column = 0.0) -> DataFrame:
    """Entries up to the first that overflows; `used` is the running total. Costs are at least 1, so a filter is the same as a break."""
    frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(cost).over(frame) + (spent if isinstance(spent, Column) else F.lit(spent))
    return entries.withColumn("used", total).where(F.col("used") <= F.lit(budget))


def pack_greedy(entries: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """Best score first (graph entries boosted), skipping what doesn't fit: per group kept ids, total, used (percent), dropped.

    entries: id, text, score, source, and grouping columns. An order-dependent fold: a group's (id, cost, score) triples are
    gathered, so groups must be result lists, not corpora.
    """
    boosted = F.when(F.col("source") == "graph", F.col("score") * GRAPH_BOOST).otherwise(F.col("score"))
    item = F.struct((-boosted).alias("rank"), F.col("id"), estimate_tokens("text").alias("cost"))
    packed = F.aggregate(
        F.sort_array(F.collect_list(item)),
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("dropped")),
        lambda a, x: F.when(
            a["total"] + x["cost"] <= budget,
            F.struct((a["total"] + x["cost"]).alias("total"), F.array_append(a["kept"], x["id"].cast("string")).alias("kept"), a["dropped"].alias("dropped")),
        ).otherwise(F.struct(a["total"].alias("total"), a["kept"].alias("kept"), (a["dropped"] + 1).alias("dropped"))),
    )
    grouped = entries.groupBy(*(by or [])).agg(packed.alias("p"))
    return grouped.select(
        *(by or []), F.col("p.kept").alias("kept"), F.col("p.total").alias("total_tokens"),
        F.floor(F.col("p.total") / budget * 100 + 0.5).cast("long").alias("budget_used"), F.col("p.dropped").alias("dropped"),
    )


def pack_text(text: str | Column, budget: int) -> Column:
    """struct(text, tokens): the text, or its leading lines within the budget less the reserve, and a note of what is left out."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(text, "\n")
    # transforms over one element bind what is costly once; without them each use would be worked out again

    def cut(lines: Column, whole: Column, folded: Column) -> Column:
        head = F.array_join(F.slice(lines, F.lit(1), folded["kept"]), "\n")
        note = F.concat(head, F.lit("\n... (truncated, "), (whole - folded["n"]).cast("string"), F.lit(" tokens omitted)"))
        return F.struct(note.alias("text"), (folded["n"] + TRUNCATION_RESERVE).alias("tokens"))

    # lines are counted first and joined once, so that a long text isn't copied line by line
    def fold(lines: Column) -> Column:
        return F.aggregate(
            lines,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("open")),
            lambda a, line: F.when(~a["open"], a).otherwise(_taken(a, estimate_tokens(line), budget - TRUNCATION_RESERVE)),
        )

    def packed(whole: Column) -> Column:
        short = F.struct(text.alias("text"), whole.alias("tokens"))
        long = F.get(F.transform(F.array(lines), lambda x: F.get(F.transform(F.array(fold(x)), lambda folded: cut(x, whole, folded)), 0)), 0)
        return F.when(whole <= budget, short).otherwise(long)

    return F.get(F.transform(F.array(estimate_tokens(text)), packed), 0)


def _taken(a: Column, cost: Column, limit: int) -> Column:
    """The fold's next state: a line is kept if its cost, worked out once, still fits."""
    return F.get(
        F.transform(
            F.array(a["n"] + cost),
            lambda n: F.when(n <= limit, F.struct(n.alias("n"), (a["kept"] + 1).alias("kept"), F.lit(True).alias("open"))).otherwise(
                F.struct(a["n"].alias("n"), a["kept"].alias("kept"), F.lit(False).alias("open"))
            ),
        ),
        0,
    )
