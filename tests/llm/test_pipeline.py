"""Each stage of the pipeline on its own input, and the queries of the subpackage on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from diglot.llm import near_dups, registry
from diglot.session import table
from diglot.storage import materialise


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    for name, stage in cp.STAGES:
        new = materialise(stage(spark, docs, sf), name)
        assert 0 < new.count()
        if name != "packing":
            assert new.columns == table(spark, sf, "documents").columns and new.count() <= docs.count()
            docs = new
    packed = {r.doc_id for r in new.select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_are_the_operators(spark, sf):
    """What a stage keeps is what the operator's query decides on the same rows."""
    docs = table(spark, sf, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    q = registry.queries()
    assert ids(cp.quality(spark, docs, sf)) == ids(q["op3_risk_controlled_rules"](spark, sf).where("kept"))
    assert ids(cp.near_duplicates(spark, docs, sf)) == ids(q["op9_bagminhash"](spark, sf).where("kept"))
    assert ids(cp.benchmark(spark, docs, sf)) == ids(docs) - ids(q["op4_cgk_decontamination"](spark, sf))
    cut = {r.doc_id: r.n_removed for r in q["op6_deletion_neighbourhood"](spark, sf).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in cp.lines(spark, docs, sf).collect():
        assert before[r.doc_id].count("\n") - r.text.count("\n") == cut[r.doc_id]


def test_pipeline_on_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert cp.packed(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    rows = table(spark, sf, "pages" if name.startswith("op2_") else "documents").count()
    n = df.count()
    assert n == rows if not name.startswith(("op1_", "op4_")) else n >= (rows if name.startswith("op1_") else 1)


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_near_duplicates_of_one_large_band(spark, monkeypatch):
    """All documents share one band and no other; copies that aren't the band's least member go too."""
    own = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(150)]
    rows = list(enumerate([*own, own[40] + " end", own[90] + " end", own[90] + " close"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = near_dups.sketch
    monkeypatch.setattr(near_dups, "sketch", lambda docs: sketch(docs).withColumn("bands", F.array(F.lit(7).cast("long"))))
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == list(range(150))
