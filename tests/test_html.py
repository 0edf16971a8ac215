import pytest

from diglot.functions import plain
from diglot.operators import dupes
from diglot.operators import html as ht
from diglot.operators import titles as tt

EN = "This is an English paragraph about things."
ZH = "这是一个关于事物的中文段落。"


def test_tree():
    root = ht.parse('<div><p>a<br>b<p>c</div><p id="x">d &amp; e</p><!-- n --><script>if (a<b) {}</script>')
    assert [x.name for x in root.elements()] == ["div", "p", "br", "p", "p", "script"]
    assert ht.render(root) == '<div><p>a<br/>b<p>c</p></p></div><p id="x">d &amp; e</p><!-- n --><script>if (a<b) {}</script>'
    assert root.text() == "a b c d & e"


def test_blocks(spark):
    docs = spark.createDataFrame([(1, f"<body><p>{EN}</p><p>{ZH}</p><p>{EN} Two.</p><ul><li>{EN} Three <code>x</code></li></ul><td>12</td></body>")], "id int, html string")
    rows = ht.blocks(docs, "id", "html").orderBy("node").collect()
    assert [(r.tag, r.has_translation, r.eligible) for r in rows] == [("p", True, False), ("p", False, False), ("p", False, True), ("li", False, True), ("td", False, False)]
    assert rows[3].text.endswith("Three x") and rows[3].visible.endswith("Three")


def test_blocks_agree_with_the_tree(spark, sf):
    from diglot.session import table

    pages = table(spark, sf, "pages")
    got = {r.page_id: r.n for r in ht.blocks(pages, "page_id", "html").where("eligible").groupBy("page_id").count().withColumnRenamed("count", "n").collect()}
    for r in pages.collect():
        assert got.get(r.page_id, 0) == len(ht.eligible(ht.parse(r.html)))


def test_insertion():
    html, n = ht.insert(f'<table><td>{EN}</td></table><ol><li>{EN} b</li></ol><p id="k" class="c">{EN} c</p><p>{EN} d</p>', {0: "表格单元", 1: "列表项目", 2: "段落内容", 3: "English reply"})
    assert n == 3 and '<p class="c">段落内容</p>' in html and f"{EN}<br/>表格单元</td>" in html and "列表项目</li>" in html and "English reply" not in html
    assert ht.insert("<p>Some text here</p>", {0: "Some text here"}) == ("<p>Some text here</p>", 0)


@pytest.mark.parametrize(("a", "b", "want"), [
    ("Same text.", "same text", True), ("[3] Smith wrote this", "[3] 史密斯写了这个内容", True), ("[3] Smith wrote this", "[3] Jones wrote that", False),
    ("图 3.1 系统的结构图示", "图 3.1 中的正文讨论", False), ("...", "…", False), ("...", "...", True), ("", "", False),
    ("Deep Learning with Python and Keras", "Deep Learning with Python and Keras 深度学习实战教程中文版的内容介绍以及更多的详细说明文字在这里", True),
    ("第 3 章 概述", "第3章概述", True),
])
def test_alike(spark, a, b, want):
    assert plain.Shape(a).like(plain.Shape(b)) is (want and bool(a))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(dupes.alike("a", "b").alias("x")).first().x is (want and bool(a))


def test_collapse():
    once, n = ht.collapse(f"<body><p>{EN}</p><p>{ZH}</p><p>{ZH}</p></body>")
    assert n == 1 and once == f"<body><p>{EN}</p><p>{ZH}</p></body>"
    assert ht.collapse(f"<table><tr><td>{EN}</td><td>{EN}</td></tr></table>")[1] == 0
    assert ht.collapse(f"<p>{EN}</p><td>x y</td><p>{EN}</p>")[1] == 0
    assert ht.collapse("<p>本章介绍市场</p><p>本章小结市场</p>")[1] == 0
    assert ht.collapse(None) == ("", 0)


def test_surplus_in_spark_is_the_fold(spark):
    rows = [(f, i, t) for f in (1, 2) for i, t in enumerate([EN, EN, ZH, ZH + "！", "Another one here", EN])]
    got = sorted(tuple(r) for r in dupes.surplus(spark.createDataFrame(rows, "f int, o int, t string"), "f", "o", "t").collect())
    want = [(f, k) for f in (1, 2) for k in plain.surplus([t for g, _, t in rows if g == f], [False] * 6)]
    assert got == want and want


def test_target_only():
    assert ht.without_source(f"<p>{EN}</p><p>{ZH}</p>") == (f"<p>{ZH}</p>", 1)
    assert ht.without_source(f"<p>{EN}</p><p>{EN} Two.</p><p>{ZH}</p>")[0] == f"<p>{EN}</p><p>{ZH}</p>"
    for kept in (f"<p>{EN}</p>", f"<h1>{EN}</h1><h1>{ZH}</h1>", f"<tr><td>{EN}</td><td>{ZH}</td></tr>", f"<p>{EN}</p><h2>{ZH}</h2>"):
        assert ht.without_source(kept)[1] == 0


def test_titles():
    html = '<html><head><title>The Book</title></head><body><h1>Chapter One</h1><h2>Part</h2><h2>部分</h2><p>no</p></body></html>'
    assert tt.titles_in(html, "a.html") == ["The Book", "Chapter One"]
    nav = '<ul><li><a href="a.html">First</a></li><li><a href="b.html">Second</a></li></ul>'
    assert tt.titles_in(nav, "nav.xhtml") == ["First", "First", "Second", "Second"] and tt.titles_in(nav, "x.html") == []
    out, n = tt.apply(nav, "toc.html", {"First": "第一", "Second": "第二"})
    assert out == '<ul><li><a href="a.html">第一</a></li><li><a href="b.html">第二</a></li></ul>' and n >= 2
    assert tt.apply(html, "a.html", {"Chapter One": "第一章"})[0].count("第一章") == 1


def test_distinct_titles_keep_first_place(spark):
    docs = spark.createDataFrame([("b", "toc.html", 1, "<a>Two</a><a>One</a>"), ("b", "nav.html", 0, "<a>One</a>")], "book string, path string, ord int, text string")
    got = [(r.title, r.ord) for r in tt.collect(docs, "book", "path", "ord", "text").orderBy("ord").collect()]
    assert got == [("One", 1), ("Two", 2)]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + f"<p>{EN}</p>", f"<p>{EN}" * 100_000, "<div><p>a b c d</p>" * 50_000, f"<p>{EN}</p><p>{ZH}</p>" * 20_000, "</p></div><b>" * 50_000])
def test_deep_and_wide_pages_take_linear_time(page):
    import time

    began = time.process_time()
    root = ht.parse(page)
    assert ht.parse(ht.render(root)).elements().__next__().name == next(root.elements()).name
    ht.collapse(page), ht.without_source(page), ht.insert(page, {0: ZH}), tt.titles_in(page, "x.html"), ht._records(page)
    assert len(ht.leaves(root)) == len({id(x) for x in root.elements() if x.name in ht.BLOCKS and not any(k.name in ht.BLOCKS for k in x.kids if isinstance(k, ht.Node))})
    assert time.process_time() - began < 60


def test_trees_agree_with_a_plain_recursion():
    import random

    rng = random.Random(5)
    for _ in range(200):
        page = "".join(rng.choice(["<p>", "<div>", "<li>", "</p>", "</div>", "</li>", "<br>", "<b>", "</b>", "text ", "文字文字 ", "<td>", "<code>"]) for _ in range(40))
        root = ht.parse(page)

        def below(x):
            return [z for k in x.kids if isinstance(k, ht.Node) for z in (k, *below(k))]

        every = below(root)
        assert [id(x) for x in root.elements()] == [id(x) for x in every]
        assert [id(x) for x in ht.leaves(root)] == [id(x) for x in every if x.name in ht.BLOCKS and not any(z.name in ht.BLOCKS for z in below(x))]
        after = ht.successors(root)
        assert all(after.get(id(x)) is x.following() for x in every)
        assert all(x.depth == sum(1 for _ in x.up()) and x.unseen == any(y.name in ht.UNSEEN for y in (x, *x.up())) for x in every)


def test_trees_are_freed_at_once():
    import gc

    page = "<body><div><p>Some English text</p><p>一些中文内容</p><p>一些中文内容</p></div></body>"
    gc.collect()
    gc.disable()
    try:
        for f in (ht._records, ht.collapse, ht.without_source, lambda h: ht.insert(h, {0: "新的内容"})):
            f(page)
        assert not any(isinstance(x, ht.Node) for x in gc.get_objects())
    finally:
        gc.enable()
