"""Glossary terms: variants, boundaries, placeholders, hints. Terms are arrays of structs in a row, or a table to join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diglot.functions.text import bound

TERM = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
HEAD = "【术语】以下词语一律采用所给译法："
FOOT = "形如 @@BTn@@ 的标记请照抄。"


def variants(source: Column, aliases: Column) -> Column:
    """The distinct spellings of a term, the longest first; equal lengths keep their order."""
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array(source), F.coalesce(aliases, F.array().cast("array<string>"))), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
    placed = F.transform(every, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(placed), lambda x: x["v"])


def pattern(v: Column) -> Column:
    """A spelling as a regular expression; letters and digits at both ends need a boundary.

    The literal stands first, and what is before it is looked at where it was found, not at each character.
    """
    literal = F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(v.rlike("^[A-Za-z0-9]") & v.rlike("[A-Za-z0-9]$"), F.concat(literal, F.lit("(?<![A-Za-z0-9]"), literal, F.lit(")(?![A-Za-z0-9])"))).otherwise(literal)


def compiled(terms: DataFrame) -> DataFrame:
    """terms with their variants, patterns and greatest length."""
    found = terms.withColumn("variants", variants(F.col("source"), F.col("aliases")))
    return found.withColumn("patterns", F.transform("variants", pattern)).withColumn("longest", F.coalesce(F.length(F.get("variants", F.lit(0))), F.lit(0)))


def line(source: Column, target: Column, aliases: Column) -> Column:
    extra = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit("（"), F.array_join(aliases, " / "), F.lit("）"))).otherwise("")
    return F.concat(F.lit("- "), source, extra, F.lit(" → "), target)


def hint(lines: Column) -> Column:
    """The prompt's glossary block for lines in order; '' for none."""
    return F.when(F.size(lines) == 0, "").otherwise(F.concat_ws("\n", F.lit(HEAD), F.array_join(lines, "\n"), F.lit(FOOT)))


def within_budget(terms: DataFrame, most: int = 3500) -> DataFrame:
    """The terms at the head of the list whose hint fits; the first always."""
    size = F.length(line(F.col("source"), F.col("target"), F.col("aliases"))) + 1
    total = F.sum(size).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return terms.withColumn("total", total + len(HEAD) + 1 + len(FOOT)).withColumn("rank", F.row_number().over(Window.orderBy("ord"))).where((F.col("total") <= most) | (F.col("rank") == 1)).drop("total", "rank")


def inject(user: Column, block: Column) -> Column:
    """A prompt with the hint before its first {text}, or at its end; unchanged without a hint."""
    at = F.instr(user, "{text}")
    before = F.concat(F.left(user, at - 1), block, F.lit("\n\n"), F.substring(user, at, F.length(user)))
    return F.when(block == "", user).when(at > 0, before).otherwise(F.concat(F.regexp_replace(user, "[\\s\\x1c-\\x1f\\x85\\p{Z}]+$", ""), F.lit("\n\n"), block))


def appearing(texts: DataFrame, terms: DataFrame, group: str, text: str = "text") -> DataFrame:
    """group, ord: the terms that match inside one text of each group.

    The glossary is a small table: it is broadcast if Spark finds it under its threshold. The plain
    contains() is a cheap filter before the boundary's regular expression.
    """
    spelled = compiled(terms).select("ord", F.explode(F.arrays_zip("variants", "patterns")).alias("v")).select("ord", "v.variants", "v.patterns")
    hit = F.col(text).contains(F.col("variants")) & F.expr(f"`{text}` RLIKE patterns")
    return texts.where(F.col(text).isNotNull() & (F.col(text) != "")).join(spelled, hit).select(group, "ord").distinct()


def ordered(terms: Column) -> Column:
    """array<struct<ord,target,variants,patterns>>: terms with the longest spelling first, then in glossary order."""
    return F.array_sort(terms, lambda a, b: F.when(F.length(F.get(a["variants"], F.lit(0))) > F.length(F.get(b["variants"], F.lit(0))), -1).when(F.length(F.get(a["variants"], F.lit(0))) < F.length(F.get(b["variants"], F.lit(0))), 1).otherwise(a["ord"] - b["ord"]))


def quoted(c: Column) -> Column:
    """A text as the replacement of a regular expression."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def protect(text: Column, terms: Column, start: int = 0) -> Column:
    """struct<text, map: array<struct<ph,target>>>: for each term its longest spelling found is a placeholder everywhere.

    A spelling that the text doesn't contain needs no regular expression, which each text would compile anew.
    """
    seed = F.struct(text.alias("text"), F.array().cast("array<struct<ph:string,target:string>>").alias("map"))

    def step(acc: Column, term: Column) -> Column:
        there = lambda i: F.coalesce(acc["text"].contains(F.get(term["variants"], i)), F.lit(True))
        hit = F.filter(term["patterns"], lambda p, i: there(i) & F.regexp_like(acc["text"], p))
        ph = F.concat(F.lit("@@BT"), (F.size(acc["map"]) + start).cast("string"), F.lit("@@"))
        done = lambda p: F.struct(F.regexp_replace(acc["text"], p, ph).alias("text"), F.concat(acc["map"], F.array(F.struct(ph.alias("ph"), term["target"].alias("target")))).alias("map"))
        return bound(F.get(hit, F.lit(0)), lambda p: F.when(p.isNotNull(), done(p)).otherwise(acc))

    return F.aggregate(terms, seed, step)


def restore(text: Column, mapping: Column, terms: Column | None = None) -> Column:
    """Placeholders become targets; spellings that are left become targets too."""
    out = F.aggregate(mapping, text, lambda acc, m: F.replace(acc, m["ph"], m["target"]))
    if terms is None:
        return out
    pairs = F.flatten(F.transform(terms, lambda t: F.transform(F.filter(t["variants"], lambda v: v != t["target"]), lambda v: F.struct(pattern(v).alias("p"), t["target"].alias("t")))))
    return F.aggregate(pairs, out, lambda acc, x: F.regexp_replace(acc, x["p"], quoted(x["t"])))
