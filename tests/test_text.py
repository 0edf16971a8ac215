"""Measures and keys of texts: the columns against pinned values and against plain Python."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from diglot.functions import plain
from diglot.functions import text as tx

SAMPLES = ["", " ", "Hello, world", "第 3 章 开始", "作者：张三", "[12] Smith, J. (2020) A title", "图 3.1 结构", "a b​c", "“quoted” ‘text’", "İK kelvin", "http://x.org/a", "www.x.org", "doi:10.1", "12 - 34", "中文 and English", "café naïve", "ab", "a", "x　y z\x1cw", "TITLE.html", "Chapter 1", "（上）第一部分的内容是这样的", "a" * 130]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_columns_agree_with_python(spark):
    for expr, f in [(tx.norm("t"), plain.norm), (tx.han("t"), lambda t: plain.counts(t)[0]), (tx.roman("t"), lambda t: plain.counts(t)[1]), (tx.skipped("t"), plain.skipped), (tx.is_title("t"), plain.is_title), (tx.duplicate_key("t"), plain.duplicate_key), (tx.core("t"), plain.core), (tx.chinese("t"), plain.chinese), (tx.citation("t"), lambda t: plain.Shape(t).cite), (tx.figure("t"), lambda t: plain.Shape(t).figure)]:
        assert column(spark, SAMPLES, expr) == [f(t) for t in SAMPLES]


def test_every_printable_character(spark):
    """norm and the script counts, over all of Unicode, a block of characters a row."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    rows = ["".join(f"a{c}b" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    assert column(spark, rows, tx.norm("t")) == [plain.norm(r) for r in rows]
    assert column(spark, rows, tx.han("t")) == [plain.counts(r)[0] for r in rows]
    assert column(spark, rows, tx.roman("t")) == [plain.counts(r)[1] for r in rows]


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("中文", 2), ("中文ab", 3), (None, 0)])
def test_tokens(spark, text, tokens):
    assert column(spark, [text], tx.tokens("t")) == [tokens]


def test_reply_budget(spark):
    df = spark.createDataFrame([(0, 1), (1000, 5), (100000, 12)], "e int, n int")
    assert [r.b for r in df.orderBy("e").select(tx.reply_budget(F.col("e"), F.col("n")).alias("b")).collect()] == [800, 1850, 8000]


def test_small_functions(spark):
    assert column(spark, ["x" * 130, "short"], tx.snippet("t")) == ["x" * 119 + "…", "short"]
    assert column(spark, ['a&b"<c'], tx.attribute("t")) == ["a&amp;b&quot;&lt;c"]
    assert column(spark, ["{ns}item", "item", None], tx.local_name("t")) == ["item", "item", ""]
    assert column(spark, ['a/b:c*?"d', " .x. ", "...", "", "y" * 200], tx.safe_name("t")) == ["a_b_c_d", "x", "book", "book", "y" * 120]
    assert column(spark, ['{"code": 429}', '{"code": "x", "status": 503}', '{"status_code": 99}', "no"], tx.error_status(F.col("t"))) == [429, 503, None, None]
    assert column(spark, ['{"a": 3}', '{"b": "4"}', "{}"], tx.usage(F.col("t"), "a", "b")) == [3, 4, 0]


def test_utf8_declarations(spark):
    given = ["<?xml version='1.0' encoding='GBK'?><a/>", "<?xml version='1.0' encoding='utf-8'?><a/>", "<meta charset='gb2312'>", "<meta content='text/html; charset=latin-1' http-equiv='Content-Type'>", "<meta charset=UTF-8>", "none"]
    want = ["<?xml version='1.0' encoding='utf-8'?><a/>", given[1], "<meta charset='utf-8'>", "<meta content='text/html; charset=utf-8' http-equiv='Content-Type'>", given[4], "none"]
    assert column(spark, given, tx.declare_utf8("t")) == want


def test_pure_columns_need_no_python(spark):
    df = spark.createDataFrame([("a",)], "t string").select(tx.norm("t"), tx.skipped("t"), tx.duplicate_key("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_whole_pages_are_escaped(spark, sf):
    from hashlib import sha1

    from diglot import registry
    from diglot.session import table

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").select("page_id", "html").collect()}
    assert any(len(x or "") > 400 for x in pages.values())
    got = {r.page_id: r.escaped for r in registry.queries()["escaped_pages"](spark, sf).collect()}
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    assert got == {i: None if x is None else sha1(escape(x).encode()).hexdigest() for i, x in pages.items()}
