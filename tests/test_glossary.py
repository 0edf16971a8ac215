from pyspark.sql import functions as F

from diglot.functions import glossary as gl
from diglot.operators.titles import protect_html
from diglot.sources.records import glossary_terms, load_glossary

ROWS = [(0, "Sharpe ratio", "夏普比率", ["sharpe ratios", "sharpe ratio"]), (1, "alpha", "阿尔法", []), (2, "C++", "C加加", ["cpp"]), (3, "GAN", "生成网络", ["GANs"])]


def terms(spark):
    return spark.createDataFrame(ROWS, gl.TERM)


def with_terms(spark, texts):
    comp = [r.asDict(recursive=True) for r in gl.compiled(terms(spark)).collect()]
    comp.sort(key=lambda r: (-r["longest"], r["ord"]))
    given = F.array(*[F.struct(F.lit(c["ord"]).alias("ord"), F.lit(c["target"]).alias("target"), F.array(*map(F.lit, c["variants"])).alias("variants"), F.array(*map(F.lit, c["patterns"])).alias("patterns")) for c in comp])
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("terms", given)


def test_variants_are_distinct_and_longest_first(spark):
    got = {r.ord: r.variants for r in gl.compiled(terms(spark)).collect()}
    assert got[0] == ["sharpe ratios", "Sharpe ratio", "sharpe ratio"] and got[3] == ["GANs", "GAN"]


def test_appearing_needs_boundaries_and_one_text(spark):
    texts = spark.createDataFrame([("a", "the alpha of GANs"), ("b", "alphabet"), ("c", "Sharpe"), ("c", "ratio"), ("d", "use C++17"), ("e", None)], "g string, text string")
    got = sorted(tuple(r) for r in gl.appearing(texts, terms(spark), "g").collect())
    assert got == [("a", 1), ("a", 3), ("d", 2)]


def test_protect_takes_the_longest_spelling_only(spark):
    df = with_terms(spark, ["sharpe ratios and Sharpe ratio", "alpha alpha", "none here"])
    got = [r.p for r in df.select("i", gl.protect(F.col("t"), F.col("terms")).alias("p")).orderBy("i").collect()]
    assert got[0].text == "@@BT0@@ and Sharpe ratio" and [(m.target, m.ph) for m in got[0]["map"]] == [("夏普比率", "@@BT0@@")]
    assert got[1].text == "@@BT0@@ @@BT0@@" and got[2].text == "none here" and got[2]["map"] == []


def test_restore_locks_what_is_left(spark):
    df = with_terms(spark, ["sharpe ratios and Sharpe ratio of alpha"]).withColumn("p", gl.protect(F.col("t"), F.col("terms")))
    assert df.select(gl.restore(F.col("p.text"), F.col("p.map"), F.col("terms")).alias("x")).first().x == "夏普比率 and 夏普比率 of 阿尔法"


def test_targets_are_literal(spark):
    df = spark.createDataFrame([("pay x",)], "t string")
    t = F.array(F.struct(F.lit(0).alias("ord"), F.lit("$1\\2").alias("target"), F.array(F.lit("x")).alias("variants"), F.array(F.lit("x")).alias("patterns")))
    none = F.array().cast("array<struct<ph:string,target:string>>")
    assert df.select(gl.restore(F.col("t"), none, t).alias("x")).first().x == "pay $1\\2"


def test_hint_budget_and_injection(spark):
    many = spark.createDataFrame([(i, f"source{i}" * 10, "目标", []) for i in range(100)], gl.TERM)
    kept = gl.within_budget(many, 500)
    assert 1 <= kept.count() < 100 and gl.within_budget(many, 1).count() == 1
    df = spark.createDataFrame([("Do: {text}", "H"), ("Do it", "H"), ("Do: {text}", "")], "u string, h string")
    assert [r.x for r in df.select(gl.inject(F.col("u"), F.col("h")).alias("x")).collect()] == ["Do: H\n\n{text}", "Do it\n\nH", "Do: {text}"]


def test_json_glossaries(spark, tmp_path):
    raw = ['{"terms":[{"source":" a ","target":"甲","aliases":"b"},{"source":"","target":"x"},{"source":"c","target":"丙","aliases":["c"," ","d"]}]}', '[{"source":"e","target":"戊"}]', "not json", "5"]
    got = [(r.source, r.target, r.aliases) for r in glossary_terms(spark.createDataFrame([(r,) for r in raw], "value string")).collect()]
    assert sorted(got) == [("a", "甲", ["b"]), ("c", "丙", ["d"]), ("e", "戊", [])]
    path = tmp_path / "x" / "glossary.json"
    assert load_glossary(spark, str(path)).count() == 0 and path.exists()


def test_html_numbers_run_on_across_nodes():
    html, marks = protect_html("<p>alpha and <b>alpha</b> <code>alpha</code></p>", [("alpha", "阿")])
    assert html == "<p>@@BT0@@ and <b>@@BT1@@</b> <code>alpha</code></p>" and marks == [("@@BT0@@", "阿"), ("@@BT1@@", "阿")]


def test_a_large_glossary(spark):
    many = spark.createDataFrame([(i, f"term{i}x", f"词{i}", [f"alias{i}x"]) for i in range(600)], gl.TERM)
    texts = spark.createDataFrame([("a", "here is term7x and alias599x but not term60")], "g string, text string")
    assert sorted(r.ord for r in gl.appearing(texts, many, "g").collect()) == [7, 599]


def test_spellings_that_are_not_there_need_no_expression(spark):
    df = spark.createDataFrame([("an alpha, alphabet",)], "t string")
    term = lambda v, p: F.struct(F.lit(0).alias("ord"), F.lit("甲").alias("target"), F.array(F.lit(v)).alias("variants"), F.array(p).alias("patterns"))
    given = F.array(term("zeta", F.lit("(")), term("alpha", gl.pattern(F.lit("alpha"))))
    assert df.select(gl.protect(F.col("t"), given)["text"].alias("x")).first().x == "an @@BT0@@, alphabet"
