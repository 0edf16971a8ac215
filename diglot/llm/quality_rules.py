"""Quality rules with risk-controlled cutoffs.

Four rules reject a text when a measure reaches a cutoff: marks a word, the share of upper-case
letters, the share of words equal to the word before, the share of words in repeated eight-word
windows. Each rule has a fixed ladder of cutoffs, from lenient to strict. In each stratum (a language)
the documents labelled good are the holdout. A cutoff is accepted if an exact binomial test at level
delta / (strata * rules) says that the rule rejects less than alpha / rules of the good documents;
the ladder is tested in order and ends at the first cutoff that isn't accepted, so the levels need no
further division (fixed-sequence testing), and Bonferroni covers strata and rules. With probability
1 - delta at least, each stratum then loses at most alpha of its good documents to these rules. A
stratum with too few labels accepts nothing, so nothing in it is rejected beyond the base rules.

Defined cases: a null text has no words and fails the base rules; a null language is the stratum '';
repeated rows are judged one by one; labels of one document that differ count as bad; null labels
don't count; without labels only the base rules reject; an empty table gives an empty result. Columns
of the input are never renamed or read, except the three that are named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diglot.llm import tokens, words
from diglot.storage import materialise

LADDERS: dict[str, list[float]] = {
    "marks": [4, 3, 2, 1.5, 1, 0.75, 0.5, 0.4, 0.3, 0.22, 0.16, 0.12, 0.09, 0.06],
    "upper": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.32, 0.26, 0.2],
    "again": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.22, 0.16, 0.12],
    "covered": [0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = T.StructType([T.StructField(n, T.LongType()) for n in BASE] + [T.StructField(n, T.DoubleType()) for n in LADDERS])
WINDOW = 8
_SYMBOL, _MARK, _HEAD = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"#*$%&|<>!=+@^_~\\{}[]")] = True
_HEAD[0x80:0xC0] = False


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive edges."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of each text of a column."""
    w = words.split(column)
    data, edges, n = w.data, w.offsets, w.count
    bounds = w.bounds()
    out = {"n_words": n, "n_symbols": _sums(_SYMBOL[data], edges)}
    out["word_chars"] = _sums(_HEAD[data] & words.IS_WORD[data], edges)

    # lines with a word
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([edges[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(edges, starts, side="right") - 1
    ends = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, starts)], edges[row + 1])
    has_word = np.searchsorted(w.first, ends) > np.searchsorted(w.first, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    value = words.span_hash(data, starts, ends)
    key = np.stack([row.astype(np.uint64), value])
    unique = np.unique(key, axis=1)[0].astype(np.int64) if len(row) else row
    out["n_dup_lines"] = np.bincount(row, minlength=len(n)) - np.bincount(unique, minlength=len(n))

    # words in eight-word windows that come twice
    h, r = words.windows(w, WINDOW)
    full = n[r] >= WINDOW
    many = np.maximum(n - WINDOW + 1, 0)
    begin = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[:-1], many)
    h, r = h[full], r[full]
    order = np.lexsort((h, r))
    same = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + WINDOW + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover)[: len(w.hash)] > 0, bounds)

    words_or_1 = np.maximum(n, 1)
    lower = _sums((data >= 97) & (data <= 122), edges)
    upper = _sums((data >= 65) & (data <= 90), edges)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    out["marks"] = _sums(_MARK[data], edges) / words_or_1
    out["upper"] = upper / np.maximum(upper + lower, 1)
    out["again"] = _sums(again, bounds) / words_or_1
    out["covered"] = out["n_repeat_words"] / words_or_1
    return out


def with_features(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs and a struct column `name` of FEATURES; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an idle worker keeps its memory for a minute, while the JVM needs it for the lines
        tokens.release()
        for batch in batches:
            for rows in words.slices(batch, text_col):
                m = measure(rows.column(text_col))
                fields = [pa.array(m[f.name], pa.int64() if f.dataType == T.LongType() else pa.float64()) for f in FEATURES]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(fields, names=FEATURES.names)], names=[*rows.schema.names, name])
            batch = rows = m = fields = None
            tokens.trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, FEATURES)]))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly from the larger terms."""
    if k >= n or p <= 0:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q
    if k + 1 > n * p:
        return max(0.0, 1.0 - math.fsum(math.exp(term(i)) for i in range(k + 1, min(n, k + 1 + int(40 + 20 * math.sqrt(n * p * (1 - p) + 1))) + 1)))
    return min(1.0, math.fsum(math.exp(term(i)) for i in range(max(0, k - int(40 + 20 * math.sqrt(n * p * (1 - p) + 1))), k + 1)))


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate at confidence 1 - level, after k of n."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(k, n, mid) > level else (low, mid)
    return high


def choose(rejected: list[int], n: int, limit: float, level: float) -> int:
    """How many cutoffs of a ladder are accepted, given how many of n good documents each rejects."""
    for i, k in enumerate(rejected):
        if n == 0 or at_most(k, n, limit) > level:
            return i
    return len(rejected)


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """For each stratum, the accepted cutoff of each rule (null if none), the holdout's size and the bound on false rejections.

    measured: doc_id, stratum, f (FEATURES). Counts of good documents are summed before the shuffle;
    after it there is a row per stratum.
    """
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = measured.join(good.select("doc_id"), "doc_id", "left_semi")
    counts = [F.sum(F.when(F.col("f")[rule] >= c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    by = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts).withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    names = list(LADDERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                out: dict = {"stratum": r["stratum"], "n_good": int(r["n"])}
                level = delta / (int(r["strata"]) * len(names))
                bound = 0.0
                for rule in names:
                    ks = [int(r[f"{rule}_{i}"]) for i in range(len(LADDERS[rule]))]
                    taken = choose(ks, int(r["n"]), alpha / len(names), level)
                    out[rule] = LADDERS[rule][taken - 1] if taken else None
                    bound += upper_bound(ks[taken - 1], int(r["n"]), level) if taken else 0.0
                rows.append(out | {"bound": bound})
            yield pd.DataFrame(rows, columns=["stratum", "n_good", *names, "bound"]).astype({n: "float64" for n in names})

    return by.mapInPandas(run, "stratum string, n_good long, " + ", ".join(f"{n} double" for n in names) + ", bound double")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def _rejected(f: Column, cutoff: Column) -> Column:
    """A cutoff that is null or NaN rejects nothing."""
    out = F.lit(False)
    for rule in LADDERS:
        c = cutoff[rule]
        out = out | F.coalesce(~F.isnan(c) & (f[rule] >= c), F.lit(False))
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return with_features(chosen, "f").drop("text")


def _cut(cutoffs: DataFrame, name: str, key: str) -> DataFrame:
    return cutoffs.select(F.col("stratum").alias(key), F.struct(*LADDERS).alias(name))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every document."""
    measured = materialise(_measured(docs, "doc_id", "text", "lang"), "measured")
    joined = measured.join(_cut(calibrate(measured, labels, alpha, delta), "cut", "stratum"), "stratum", "left")
    failed = base_failed(F.col("f"))
    return joined.select("doc_id", *[F.col("f")[n].alias(n) for n in BASE], failed.alias("base_failed"), (~failed & ~_rejected(F.col("f"), F.col("cut"))).alias("kept"), *[F.col("f")[n].alias(n) for n in LADDERS])


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    f, cut, key = (next(n for n in (base + "_" * i for i in range(99)) if n not in taken) for base in ("quality_f", "quality_cut", "quality_key"))
    cutoffs = materialise(calibrate(materialise(_measured(docs, "doc_id", "text", "lang"), "measured"), labels, alpha, delta), "cutoffs")
    keyed = with_features(docs, f).withColumn(key, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    joined = keyed.join(_cut(cutoffs, cut, key), key, "left")
    return joined.where(~base_failed(F.col(f)) & ~_rejected(F.col(f), F.col(cut))).select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["BASE", "LADDERS", "calibrate", "judge", "keep_good", "measure"]
