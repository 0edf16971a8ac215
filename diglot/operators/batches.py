"""Bounded batches, rolling context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import paths
from diglot.functions import text as tx

ITEMS, TOKENS, SHORT_ITEMS, SHORT_TOKENS, CONTEXT = 12, 1600, 8, 600, 2
CONTEXT_HEAD = "【前文】仅供参考，请勿重译："
ASK = "下列共 {} 段英文，请译为简体中文，格式如下：\n1. 译文\n2. 译文\n每段一条，按编号输出，不加说明。\n\n"
ASK_ONE = "请译为简体中文，仅给出译文：\n"
REMINDER = "【注意格式】一行一条，以「编号. 」开头；请勿使用其他标记。\n\n"


def limits(name: Column | str, short_names: Column | None = None) -> tuple[Column, Column]:
    """Most items and tokens of a batch for a file of this name; short_names lists further short files."""
    short = paths.is_short(name)
    if short_names is not None:
        short = short | F.array_contains(short_names, paths.basename(name))
    return F.when(short, SHORT_ITEMS).otherwise(ITEMS), F.when(short, SHORT_TOKENS).otherwise(TOKENS)


def batch_starts(costs: Column, most_items: Column, most_tokens: Column) -> Column:
    """Where the batches of an array of token costs begin: greedy, in order, one item at least in each.

    The fold's array grows by a batch at a time, not by an item.
    """
    budget = F.when(most_tokens < 1, F.lit(TOKENS)).otherwise(most_tokens)
    items = F.greatest(most_items, F.lit(1))
    seed = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array(F.lit(0)).alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= items) | (acc["used"] + cost > budget))
        out = F.when(full, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"])
        return F.struct((acc["at"] + 1).alias("at"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), (F.when(full, 0).otherwise(acc["used"]) + cost).cast("long").alias("used"), out.alias("out"))

    return F.aggregate(costs, seed, step)["out"]


def places(blocks: DataFrame, file: str, order: str, text: str, name: str | None = None) -> DataFrame:
    """file, order, batch of each block. Only costs and order are gathered, one array a file."""
    items, most = limits(name or F.lit("")) if name else (F.lit(ITEMS), F.lit(TOKENS))
    keys = [file, *([name] if name and name != file else [])]
    grouped = blocks.select(*keys, F.struct(F.col(order).alias("o"), tx.tokens(text).alias("c")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    begun = grouped.select(file, "s", batch_starts(F.transform("s", lambda x: x["c"]), items, most).alias("b"))
    batch = begun.select(file, "s", "b", F.posexplode("b").alias("batch", "start"))
    end = F.coalesce(F.get("b", F.col("batch") + 1), F.size("s"))
    return batch.select(file, "batch", F.explode(F.slice("s", F.col("start") + 1, end - F.col("start"))).alias("x")).select(file, F.col("x.o").alias(order), "batch")


def pack(blocks: DataFrame, file: str, order: str, text: str, name: str | None = None) -> DataFrame:
    """blocks with their batch within the file."""
    return blocks.join(places(blocks, file, order, text, name), [file, order])


def context(source: str, target: str, most: int = CONTEXT) -> Column:
    """The prompt's block of the last pairs before a row. Use over rows of one file in order: see `with_context`."""
    return F.struct(F.col(source).alias("en"), F.col(target).alias("zh"))


def with_context(pairs: DataFrame, file: str, order: str, source: str, target: str, most: int = CONTEXT) -> DataFrame:
    """pairs with the last `most` accepted pairs before each (target has two CJK characters), and the prompt's block."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    taken, one = tx.han(target) >= 2, F.array(context(source, target))
    found = F.slice(one, 1, 0)
    rows = pairs
    # each step knows one pair more: the last accepted row's own, after those that it knew
    for k in range(1, most + 1):
        known = F.concat(found, one)
        state = F.when(taken, F.slice(known, F.greatest(F.size(known) - k + 1, F.lit(1)), k))
        rows = rows.withColumn("context", F.coalesce(F.last(state, ignorenulls=True).over(before), F.slice(one, 1, 0)))
        found = F.col("context")
    return rows.withColumn("context_text", context_text(F.col("context")))


def context_text(pairs: Column) -> Column:
    lines = F.transform(pairs, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". EN: "), p["en"], F.lit("\n   ZH: "), p["zh"]))
    return F.when(F.size(pairs) == 0, "").otherwise(F.concat(F.lit(CONTEXT_HEAD + "\n"), F.array_join(lines, "\n"), F.lit("\n\n")))


def prompt(prefix: Column, items: Column) -> Column:
    """The request for a batch of (protected) items."""
    numbered = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    head, tail = ASK.split("{}")
    ask = F.concat(F.lit(head), F.size(items).cast("string"), F.lit(tail))
    return F.concat(prefix, ask, numbered)


def single_prompt(prefix: Column, item: Column) -> Column:
    return F.concat(prefix, F.lit(ASK_ONE), item)


def slices(order: Column, size: int = 40) -> Column:
    """Fixed slices of ranked rows (titles)."""
    return F.floor((order - 1) / size).cast("int")
