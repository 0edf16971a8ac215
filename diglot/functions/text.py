"""Text measures and keys as Column expressions; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: Java's \s lacks the separators of Unicode and U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The same characters one by one: `translate` takes a quarter of the time of a regular expression that matches often.
_WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\u0130\u212a"
_MARKS = "'\"“”()《》·．。.,，、:：;；"
HAN, ROMAN = "[\\u4e00-\\u9fff]", "[A-Za-z\\u0130\\u212a]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def norm(c: Column | str) -> Column:
    """White space collapsed and trimmed, zero-width spaces dropped, curly quotes made straight; null is ''."""

    given, made = "\u2018\u2019\u201c\u201d" + _WHITE + "\u200b", "''\"\"" + " " * len(_WHITE)
    even = lambda t: F.trim(F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))
    return bound(F.translate(F.coalesce(column(c), F.lit("")), given, made), even)


def _may_have_han(c: Column, n: int = 1) -> Column:
    """Each CJK character has two bytes more than a letter: a text with too few can't have n, and needn't be searched."""
    return F.octet_length(c) - F.length(c) >= 2 * n


def _at_least(c: Column, n: int, kind: str) -> Column:
    """Whether a text has n characters of a class, read as far as the n-th."""
    return c.rlike(f"\\A(?:[^{kind[1:-1]}]*+{kind}){{{n}}}")


def han(c: Column | str) -> Column:
    """Number of CJK characters."""
    c = F.coalesce(column(c), F.lit(""))
    return F.when(_may_have_han(c), F.regexp_count(c, F.lit(HAN))).otherwise(0)


def roman(c: Column | str) -> Column:
    """Number of Latin letters, with the two others whose lower case is a to z. (regexp_count would make a string of each.)"""
    c = F.coalesce(column(c), F.lit(""))
    return F.length(c) - F.length(F.translate(c, _LETTERS, ""))


def tokens(c: Column | str) -> Column:
    """A token for each CJK character and for each four others begun; 0 for an empty text."""
    c = F.coalesce(column(c), F.lit(""))
    n, cjk = F.length(c), han(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), cjk + F.floor((n - cjk + 3) / 4).cast("int"))).cast("int")


def reply_budget(estimate: Column, items: Column) -> Column:
    """Tokens allowed for a reply to `items` texts with this estimate when joined by newlines."""
    return F.least(F.lit(8000), F.greatest(F.lit(800), F.floor(estimate * 3 / 2).cast("int") + 30 * items.cast("int") + 200))


def skipped(c: Column | str) -> Column:
    """Whether a block isn't worth translating. A text of digits and marks only has fewer than three letters."""
    return bound(norm(c), skipped_plain)


def skipped_plain(t: Column) -> Column:
    """`skipped` of a text that is normalised already."""
    return (F.length(t) < 2) | t.rlike("\\A(http|www\\.|doi:)") | ~_at_least(t, 3, ROMAN) | (_may_have_han(t, 2) & _at_least(t, 2, HAN))


def is_title(c: Column | str) -> Column:
    """Whether a text is a title left in English."""
    return bound(norm(c), lambda t: (F.length(t) >= 2) & ~(_may_have_han(t) & t.rlike(HAN)) & _at_least(t, 2, ROMAN) & ~t.rlike("^http|\\.x?html$"))


def chinese(c: Column | str) -> Column:
    """At least as many CJK characters as letters (so a text with neither counts)."""
    c = F.coalesce(column(c), F.lit(""))
    return F.when(_may_have_han(c) & c.rlike(HAN), han(c) >= roman(c)).otherwise(~c.rlike(ROMAN))


def mostly_chinese(c: Column | str) -> Column:
    """Two CJK characters, and as many as letters. Letters are counted only where there are two."""
    c = F.coalesce(column(c), F.lit(""))
    return F.when(_may_have_han(c, 2) & _at_least(c, 2, HAN), han(c) >= roman(c)).otherwise(F.lit(False))


def source_only(c: Column | str) -> Column:
    """English, or mostly English with some Chinese. All letters are counted only beside Chinese."""
    c = F.coalesce(column(c), F.lit(""))
    mixed = bound(F.struct(han(c).alias("cn"), roman(c).alias("en")), lambda n: (n["en"] >= 20) & (n["cn"] < 0.25 * (n["cn"] + n["en"])))
    return F.when(_may_have_han(c) & c.rlike(HAN), mixed).otherwise(_at_least(c, 8, ROMAN))


def duplicate_key(c: Column | str) -> Column:
    """A key that is equal for texts that differ in spaces, common marks, case or an author label."""
    # all white space goes, that between 第 and 章 too
    return F.lower(F.translate(F.regexp_replace(F.coalesce(column(c), F.lit("")), "作者[：:]", ""), _WHITE + _MARKS, ""))


def core(c: Column | str) -> Column:
    """The duplicate key without what stands in parentheses."""
    without = lambda c, mark, aside: bound(c, lambda t: F.when(t.contains(mark), F.regexp_replace(t, aside, "")).otherwise(t))
    return duplicate_key(without(without(F.coalesce(column(c), F.lit("")), "（", "（[^）]*）"), "(", "\\([^)]*\\)"))


def _found(c: Column | str, pattern: str) -> Column:
    hit = F.regexp_extract(F.coalesce(column(c), F.lit("")), pattern, 1)
    return F.when(hit != "", hit)


def citation(c: Column | str) -> Column:
    """n of a leading [n], or null."""
    return _found(c, "^[\\s\\x1c-\\x1f\\x85\\p{Z}]*\\[(\\d+)\\]")


def figure(c: Column | str) -> Column:
    """n of a leading 图 n, or null."""
    return _found(c, "^[\\s\\x1c-\\x1f\\x85\\p{Z}]*图[\\s\\x1c-\\x1f\\x85\\p{Z}]*([\\d.]+)")


def snippet(c: Column | str, most: int = 120) -> Column:
    c = column(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def cache_key(model: Column, prompt: Column, source: Column | str) -> Column:
    """SHA-1 of the model, the prompt and the normalised source, a line each."""
    return F.sha1(F.concat_ws("\n", model, prompt, norm(source)))


def declare_utf8(c: Column | str) -> Column:
    """XML and meta declarations of another encoding say utf-8; texts that say UTF-8 don't change."""
    other = "(?!utf-?8[\"'\\s/>;])"
    c = F.regexp_replace(column(c), "(?i)^(\\s*<\\?xml[^>]*?encoding=[\"'])" + other + "[^\"']+", "$1utf-8")
    return F.regexp_replace(c, "(?i)(<meta\\b[^>]*?charset\\s*=\\s*[\"']?\\s*)" + other + "[\\w.\\-]+", "$1utf-8")


def attribute(c: Column | str) -> Column:
    """A text as the value of an XML attribute."""
    c = F.replace(column(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def local_name(c: Column | str) -> Column:
    return F.substring_index(F.coalesce(column(c), F.lit("")), "}", -1)


def safe_name(c: Column | str) -> Column:
    """A file name: marks that file systems refuse are _, 120 characters at most, 'book' if nothing is left."""
    t = F.btrim(F.trim(F.regexp_replace(column(c), r'[<>:"/\\|?*]+', "_")), F.lit("."))
    return F.when(F.coalesce(t, F.lit("")) == "", "book").otherwise(F.left(t, F.lit(120)))


def error_status(payload: Column) -> Column:
    """The first of code, status and status_code in a JSON error that is an HTTP status."""
    tried = [F.get_json_object(payload, f"$.{k}").try_cast("int") for k in ("code", "status", "status_code")]
    return F.coalesce(*[F.when(x.between(100, 599), x) for x in tried])


def usage(payload: Column, *names: str) -> Column:
    """The first of the named JSON fields that is an integer, or 0."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}").try_cast("long") for n in names], F.lit(0))
