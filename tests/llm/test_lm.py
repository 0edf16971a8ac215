import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from diglot.llm import lm

from .test_words_tokens import odd_texts

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, mu):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0"] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            one.update(t)
            two.update(zip(["\1", *t], t))
            three.update(zip(["\1", *t], t, t[1:]))
    n, v, begins = sum(one.values()), len(one), one["\0"]
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    c = lambda w: begins if w == "\1" else one[w]
    p2 = lambda b, w: (two[b, w] + mu[0] * p1(w)) / (c(b) + mu[0])
    p3 = lambda a, b, w: (three[a, b, w] + mu[1] * p2(b, w)) / (two[a, b] + mu[1])
    out = []
    for (i, _), t, h in zip(rows, toks, held):
        own = math.log10(p2("\1", t[0])) + sum(math.log10(p3(*x)) for x in zip(["\1", *t], t, t[1:]))
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), own))
    return out


@pytest.mark.parametrize(("n", "fan", "most", "block"), [(0, 64, lm.RANGE, lm.BLOCK), (300, 64, lm.RANGE, lm.BLOCK), (300, 3, 4000, 5000)])
def test_scores(spark, n, fan, most, block, monkeypatch):
    """In one exchange, and in several levels of merged chunks with blocks of a few documents; a column named like one of the operator's is no matter."""
    monkeypatch.setattr(lm, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(odd_texts(n, 7))] + [(None, "a b"), (3, "a B a"), (3, "a B a"), (5, "x y " * 3000)] if n else []
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string").repartition(3)
    got = lm.score(docs, mu=(20.0, 2.0), fan=fan, most=most).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, (20.0, 2.0)), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)


def test_numbers_survive_packing():
    for values in (np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)), np.array([5], np.uint64), np.array([0, (1 << 64) - 1], np.uint64)):
        assert (lm.unpack_numbers(lm.pack_numbers(values), len(values)) == values).all()
    assert lm.unpack_counts(lm.pack_counts(np.array([1, 0, 1 << 31])), 3).tolist() == [1, 0, 1 << 31]
    assert lm.unpack_counts(lm.pack_counts(np.array([1, 1 << 33])), 2).tolist() == [1, 1 << 33]
    assert lm.unpack_counts(lm.pack_counts(np.array([0, 0])), 2).tolist() == [0, 0]


@pytest.mark.parametrize("fan", [1, 2, 7, 64])
def test_ranges_cover_all_keys(fan):
    keys = np.sort(np.random.default_rng(1).integers(0, (1 << 64) - 1, 500, dtype=np.uint64))
    edges = lm.cuts(keys, 0, 0, fan)
    assert edges[0] == 0 and edges[-1] == 500 and (np.diff(edges) >= 0).all() and len(edges) == fan + 1


def small_model(mu=(30.0, 3.0)):
    """Words a b end (the start is 3) after the training documents 'a b a', 'a b', 'b a b a'."""
    docs = [[0, 1, 0, 2], [0, 1, 2], [1, 0, 1, 0, 2]]
    one, two, three = Counter(), Counter(), Counter()
    for d in docs:
        one.update(d)
        two.update(zip([3, *d], d))
        three.update(zip([3, *d], d, d[1:]))
    pairs = sorted(two)
    triples = sorted(three)
    at = {p: i for i, p in enumerate(pairs)}
    words = np.array([one[w] for w in range(3)])
    p = np.array([two[x] for x in pairs]), np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs])
    t = np.array([three[x] for x in triples]), np.array([at[x[:2]] for x in triples]), np.array([at[x[1:]] for x in triples])
    return lm.Automaton(words, 3, p, t, int(words.sum()), 3, 2, mu)


def test_probabilities_sum_to_one_from_every_state():
    model = small_model()
    unseen = 0.1 / (12 + 0.4)
    for state in {0, model.begin, *model.known.tolist(), *model.target.tolist()}:
        p = 10 ** model.step(np.full(3, state), np.arange(3))[1]
        rest, at = unseen, state
        while at:
            rest *= 10 ** model.fail_weight[at]
            at = int(model.fail[at])
        assert p.sum() + rest == pytest.approx(1.0)


def test_pieces_carry_the_state():
    model = small_model()
    rng = np.random.default_rng(3)
    word = rng.integers(0, 2, 1000)
    start = np.zeros(1000, bool)
    start[[0, 400, 402, 403]] = True
    word[[399, 401, 402, 999]] = 2
    whole = model.traverse(word, start, 1000)
    for piece in (1, 2, 3, 64):
        assert model.traverse(word, start, piece) == pytest.approx(whole, abs=1e-12)
