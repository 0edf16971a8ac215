"""Numbered replies as a fold over lines, in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from diglot.functions.text import SPACE, column

QUOTES = '"\u201c\u201d'
#: bullet, emphasis, 第, number, 段, delimiter (a bare colon needs a space or the end), emphasis
_OPEN = r"^(?:[-+*•][\s\p{Z}]+)?(?<em>\*{1,2}|__)?(?:第[\s\p{Z}]*)?"
_CLOSE = r"(?:[\s\p{Z}]*段)?[\s\p{Z}]*(?:[、．.)）：]|:(?=[\s\p{Z}]|$))(?:\k<em>)?"


def number(line: Column) -> Column:
    """The number that a line begins with as an item, or null. The emphasis is closed only where one was opened."""
    plain = F.regexp_extract(line, r"^(?:[-+*•][\s\p{Z}]+)?(?:第[\s\p{Z}]*)?(\d{1,3})" + _CLOSE.replace(r"(?:\k<em>)?", ""), 1)
    marked = F.regexp_extract(line, _OPEN.replace("(?<em>", "(") + r"(\d{1,3})" + _CLOSE.replace(r"(?:\k<em>)?", r"(?:\1)?"), 2)
    hit = F.when(plain != "", plain).otherwise(marked)
    return F.when(hit != "", hit.cast("int"))


def content(line: Column) -> Column:
    """What stands after an item's number."""
    marked = _OPEN.replace("(?<em>", "(") + r"\d{1,3}" + _CLOSE.replace(r"(?:\k<em>)?", r"(?:\1)?") + r"[\s\p{Z}]*"
    plain = r"^(?:[-+*•][\s\p{Z}]+)?(?:第[\s\p{Z}]*)?\d{1,3}" + _CLOSE.replace(r"(?:\k<em>)?", "") + r"[\s\p{Z}]*"
    return F.when(line.rlike(plain), F.regexp_replace(line, plain, "")).otherwise(F.regexp_replace(line, marked, ""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, "^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$", "")


def unquoted(c: Column) -> Column:
    return F.btrim(c, F.lit(QUOTES))


def unwrapped(c: Column) -> Column:
    """Without quotes at both ends; a text with a quote at one end only keeps it."""
    return F.when(c.rlike(f'(?s)^[{QUOTES}].*[{QUOTES}]$'), unquoted(c)).otherwise(c)


def single(c: Column | str) -> Column:
    """A reply that is one text: white space collapsed, outer quotes dropped."""
    return unwrapped(F.trim(F.regexp_replace(column(c), SPACE, " ")))


def items(raw: Column | str, expect: Column | None = None, quotes: Callable[[Column], Column] = unquoted) -> Column:
    """map<int,string> of a reply's items.

    A numbered line begins an item if its number is above the last one's, and at most `expect`; other
    lines go on the item before; lines before the first item are left out. `quotes` drops an item's outer quotes.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(column(raw), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<i:int,t:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        n = number(line)
        begins = n.isNotNull() & (acc["last"].isNull() | (n > acc["last"]))
        if expect is not None:
            begins = begins & (n <= expect)
        put = lambda i, t: F.array(F.struct(i.alias("i"), t.alias("t")))
        before = F.slice(acc["found"], F.lit(1), F.greatest(F.size(acc["found"]) - 1, F.lit(0)))
        longer = F.concat(before, put(acc["last"], F.concat(F.element_at(acc["found"], -1)["t"], F.lit(" "), line)))
        fresh = F.concat(acc["found"], put(n, strip(content(line))))
        grown = F.struct(acc["last"].alias("last"), longer.alias("found"))
        return F.when(begins, F.struct(n.alias("last"), fresh.alias("found"))).when(acc["last"].isNull(), acc).otherwise(grown)

    # numbers only grow, so each is one entry; the fold is evaluated once
    return F.map_from_entries(F.aggregate(lines, start, step, lambda acc: F.transform(acc["found"], lambda x: F.struct(x["i"], quotes(strip(x["t"]))))))
