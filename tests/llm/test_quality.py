import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diglot.llm import quality_model as qm
from diglot.llm import quality_rules as qr
from diglot.llm import tokens
from diglot.llm.registry import public_tokenizer

from .test_words_tokens import odd_texts


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(win)
    cover = {k for i, x in enumerate(win) if twice[x] > 1 for k in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)]


def test_measures_agree_with_plain_python():
    texts = odd_texts(1500, 5) + ["a b c d e f g h " * 3, "line one\nline one\n\nline one", "x\n" * 50, "a " * 40]
    m = qr.measure(pa.array(texts))
    assert np.stack([m[k] for k in qr.BASE], 1).tolist() == [base(t) for t in texts]
    assert len(qr.measure(pa.array([], pa.string()))["n_words"]) == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.1), (10, 1000, 0.02), (49, 50, 0.9), (0, 1, 0.5)])
def test_binomial_tail_is_exact(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert qr.at_most(k, n, p) == pytest.approx(want, rel=1e-9)


def test_upper_bound_is_clopper_pearson():
    assert qr.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-9)
    b = qr.upper_bound(7, 200, 0.01)
    assert qr.at_most(7, 200, b) == pytest.approx(0.01, rel=1e-6) and qr.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_stop_at_the_first_that_fails():
    assert qr.choose([0, 1, 60, 0], 1000, 0.02, 0.01) == 2
    assert qr.choose([0, 0], 20, 0.01, 0.01) == 0 and qr.choose([], 5, 0.1, 0.1) == 0 and qr.choose([0], 0, 0.1, 0.1) == 0


def test_false_rejections_stay_within_the_limit():
    """Over many holdouts, the chosen cutoff's true rate of rejections is above the limit in at most a share `level`."""
    rng, rates, bad = np.random.default_rng(3), [0.0, 0.004, 0.015, 0.03, 0.2], 0
    for _ in range(2000):
        u = rng.random(400)
        taken = qr.choose([int((u < r).sum()) for r in rates], 400, 0.0125, 0.05)
        bad += taken > 0 and rates[taken - 1] > 0.0125
    assert bad <= 0.05 * 2000 * 1.2


CLEAN = "this is a clean text with many different words that nobody would ever want to reject number {} and it goes on for a while"


def rows(n=1500):
    out = [(i, CLEAN.format(i), "en", "x") for i in range(n)]
    out += [(n + i, "junk### words*** here$$$ and%%% there&&& " * 6 + str(i), "en", "x") for i in range(200)]
    return out + [(9001, None, None, "x"), (9002, "", "fr", "x"), (9003, "few words", "en", "x"), (9004, CLEAN.format(1), "es", "x")]


def tables(spark, some):
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, n_words string")
    labels = docs.where("doc_id < 9000").select("doc_id", F.when(F.col("text").contains("###"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    return docs, labels


def test_judge(spark):
    docs, labels = tables(spark, rows())
    got = {r.doc_id: r for r in qr.judge(docs, labels).collect()}
    assert len(got) == len(rows())
    assert sum(got[i].kept for i in range(1500)) >= 0.95 * 1500 and not any(got[1500 + i].kept for i in range(200))
    assert got[9001].n_words == 0 and got[9001].base_failed and not got[9001].kept and got[9004].kept
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_judge_without_labels_or_rows(spark):
    docs, labels = tables(spark, rows(20))
    none = labels.limit(0)
    got = qr.judge(docs, none).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert qr.judge(docs.limit(0), none).count() == 0 and qr.keep_good(docs.limit(0), none).count() == 0


def test_classifier(spark):
    docs, labels = tables(spark, rows())
    got = {r.doc_id: r for r in qm.score(docs, labels).collect()}
    held = [r for i, r in got.items() if r.held_out and i < 9000]
    assert len(got) == len(rows()) and len(held) > 200
    assert sum(r.predicted == int(r.doc_id < 1500) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in qm.score(docs, labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_classifier_never_learns_from_held_out_rows(spark):
    docs, labels = tables(spark, rows())
    flipped = labels.withColumn("quality", F.when(qm.held_out(5), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qm.score(docs, x).collect()} for x in (labels, flipped))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_classifier_without_two_classes(spark):
    docs, labels = tables(spark, rows(20))
    assert {round(r.score, 6) for r in qm.score(docs, labels.limit(0)).collect()} == {0.5}
    assert qm.score(docs.limit(0), labels).count() == 0


def test_rules_leave_no_encoder_in_a_worker():
    """A worker that packed texts before, and serves the rules now, holds no tables of pieces."""

    class Docs:
        schema = T.StructType().add("text", "string")

        def mapInArrow(self, run, schema):
            return run

    tokens.encoder(public_tokenizer("word_bpe_49k.json")).encode(["some words"])
    assert tokens._encoders
    batches = [pa.record_batch({"text": ["one two", None]}), pa.record_batch({"text": pa.array([], pa.string())})]
    out = list(qr.with_features(Docs(), "f")(iter(batches)))
    assert [b.column("f").field("n_words").to_pylist() for b in out] == [[2, 0]] and not tokens._encoders
