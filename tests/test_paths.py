import posixpath

import pytest
from pyspark.sql import functions as F

from diglot.functions import paths


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("path", ["a/b", "a/./b", "a/../b", "../a", "a/b/../../c", "/a/../b", "a//b", "a\\b", ".", "..", "../../x/../y"])
def test_normal(spark, path):
    assert one(spark, paths.normal("p"), p=path) == posixpath.normpath(path.replace("\\", "/"))


@pytest.mark.parametrize(("package", "href", "full"), [("OEBPS/content.opf", "Text/a.html#x", "OEBPS/Text/a.html"), ("OEBPS/content.opf", "../b.html", "b.html"), ("content.opf", "a.html", "a.html"), ("EPUB/p.opf", "/root.html", "root.html"), ("EPUB/p.opf", "", "")])
def test_resolve(spark, package, href, full):
    assert one(spark, paths.resolve("a", "b"), a=package, b=href) == full


@pytest.mark.parametrize(("package", "dest"), [("OEBPS/c.opf", "OEBPS/Text/a.html"), ("OEBPS/x/content.opf", "OEBPS/Text/a.html"), ("content.opf", "Text/a.html"), ("A/B/c.opf", "D/e.html")])
def test_relative(spark, package, dest):
    assert one(spark, paths.relative("a", "b"), a=package, b=dest) == posixpath.relpath(dest, posixpath.dirname(package) or ".")


@pytest.mark.parametrize(("path", "patterns", "hit"), [("OEBPS/ch01.html", "ch01.html", True), ("OEBPS/ch01.html", "1.html", True), ("OEBPS/ch01.html", "x/ch01.html", True), ("OEBPS/ch01.html", "ch02.html", False), ("OEBPS/ch01.html", "", False), ("OEBPS/ch01.html", " a , OEBPS\\ch01.html", True)])
def test_matches(spark, path, patterns, hit):
    assert one(spark, paths.matches("p", paths.names(F.col("n"))), p=path, n=patterns) is hit


@pytest.mark.parametrize(("name", "short"), [("a/References.html", True), ("footnotes.xhtml", True), ("endnotes.html", True), ("mytoc.html", True), ("index.htm", True), ("chapter.html", False), ("notes.txt", False)])
def test_short_names(spark, name, short):
    assert one(spark, paths.is_short("p"), p=name) is short


def test_small_functions(spark):
    assert one(spark, paths.likely_package("p"), p="EPUB/Text/a.html") == "EPUB/content.opf"
    assert one(spark, paths.likely_package("p"), p="x.html") == "content.opf"
    assert one(spark, paths.item_id("p"), p="a/b c.html") == "bt-a-b-c.html"
    assert one(spark, paths.common_suffix(F.col("a"), F.col("b")), a="x/Text/a.html", b="y/Text/a.html") == len("/Text/a.html")
    assert one(spark, paths.href("p"), p=" a/../b.html#frag ") == "b.html"


def test_each_path_is_folded_once(spark):
    df = spark.createDataFrame([("OEBPS/c.opf", "x/../a.html")], "a string, b string")
    folds = lambda e: df.select(e.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert (folds(paths.normal("b")), folds(paths.resolve("a", "b")), folds(paths.relative("a", "b"))) == (1, 2, 1)
