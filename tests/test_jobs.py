import pytest
from pyspark.sql import functions as F

from diglot.functions import paths
from diglot.operators import batches as bt
from diglot.operators import jobs


def members(spark, rows, last):
    return spark.createDataFrame([("b", p, i, n) for i, (p, n) in enumerate(rows)], f"book string, path string, ord int, {last} int")


def planned(spark, source, target):
    df = jobs.jobs(members(spark, source, "todo"), members(spark, target, "chinese"))
    return {r.path: r.dest for r in df.collect()}


def test_destinations(spark):
    assert planned(spark, [("Text/ch1.html", 1), ("Notes/ch1.html", 1)], [("Text/ch1.html", 0)]) == {"Text/ch1.html": "Text/ch1.html", "Notes/ch1.html": "Text/Notes_ch1.html"}
    assert planned(spark, [("a/x.html", 1)], [("q/a/x.html", 0), ("q/b/x.html", 0)]) == {"a/x.html": "q/a/x.html"}
    assert planned(spark, [("a/x.html", 0), ("a/y.html", 2)], [("top.html", 0)]) == {"a/y.html": "y.html"}
    assert planned(spark, [("a/y.html", 2)], []) == {"a/y.html": "EPUB/Text/y.html"}


def test_missing_selected_and_unfinished(spark):
    source = members(spark, [("a.html", 1), ("b.html", 1), ("c.html", 1)], "todo")
    target = members(spark, [("a.html", 3), ("b.html", 0)], "chinese")
    plan = jobs.jobs(source, target)
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(jobs.missing(plan, target)) == ["b.html", "c.html"]
    pick = lambda only, again: names(jobs.selected(plan, target, paths.names(F.lit(only)), paths.names(F.lit(again))))
    assert pick("", "") == ["b.html", "c.html"] and pick("", "a.html") == ["a.html", "b.html", "c.html"] and pick("a.html", "") == [] and pick("b.html,a.html", "a.html") == ["a.html", "b.html"]
    state = spark.createDataFrame([("b", ["b.html", "c.html"])], "book string, done array<string>")
    assert names(jobs.unfinished(plan, state, paths.names(F.lit("c.html")))) == ["a.html", "c.html"]


def test_reading_order(spark):
    source = members(spark, [("a.html", 1), ("b.html", 1), ("c.html", 1)], "todo")
    spine = spark.createDataFrame([("b", "c.html", 0), ("b", "a.html", 1)], "book string, path string, ord int")
    none = spark.createDataFrame([], "book string, base string, path string, dest string, ord int")
    got = jobs.order_of(source, spine, members(spark, [("a.html", 0), ("b.html", 0), ("c.html", 0)], "chinese"), none).orderBy("rank").collect()
    assert [r.dest for r in got] == ["c.html", "a.html", "b.html"]


def test_attempts(spark):
    state = spark.createDataFrame([("b", "x", 2, False), ("b", "y", 0, False), ("b", "z", 1, True)], "book string, dest string, attempts int, done boolean")
    results = spark.createDataFrame([("b", "x", False), ("b", "y", True), ("b", "w", False)], "book string, dest string, landed boolean")
    got = {r.dest: (r.attempts, r.done) for r in jobs.attempts(state, results).collect()}
    assert got == {"x": (3, True), "y": (0, True), "z": (1, True), "w": (1, False)}


@pytest.mark.parametrize(("value", "n"), [("3", 3), (9, 4), ("0", 1), ("x", 1), (None, 1), (" 2 ", 2)])
def test_workers(value, n):
    assert jobs.workers(value) == n


def packed(costs, items, most):
    out, batch, used, n = [], 0, 0, 0
    for c in costs:
        if n and (n >= max(items, 1) or used + c > (most if most >= 1 else 1600)):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + c, n + 1
    return out


@pytest.mark.parametrize(("costs", "items", "most"), [([100] * 30, 12, 1600), ([900, 900, 10, 5000, 10], 12, 1600), ([1, 2, 3], 0, 0), ([], 12, 1600), ([700, 700, 300], 12, 1600)])
def test_batches(spark, costs, items, most):
    df = spark.createDataFrame([(costs,)], "c array<int>")
    want = packed(costs, items, most)
    starts = df.select(bt.batch_starts(F.col("c"), F.lit(items), F.lit(most)).alias("b")).first().b
    assert starts == [k for k in range(len(want)) if not k or want[k] != want[k - 1]] or (not want and starts == [0])


def test_limits_by_name(spark):
    df = spark.createDataFrame([("a/index.html",), ("a/ch.html",), ("a/odd.html",)], "p string")
    i, t = bt.limits(F.col("p"), F.array(F.lit("odd.html")))
    assert [tuple(r) for r in df.select(i, t).collect()] == [(8, 600), (12, 1600), (8, 600)]


def test_context_skips_english_replies(spark):
    rows = [("f", 1, "one", "译文一"), ("f", 2, "two", "English"), ("f", 3, "three", "译文三"), ("f", 4, "four", "译文四")]
    got = bt.with_context(spark.createDataFrame(rows, "f string, o int, s string, t string"), "f", "o", "s", "t").orderBy("o").collect()
    assert [[c.en for c in r.context] for r in got] == [[], ["one"], ["one"], ["one", "three"]] and got[0].context_text == ""
