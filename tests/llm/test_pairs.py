"""Line dedup, near copies, decontamination: against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diglot.llm import components as cc
from diglot.llm import decontaminate as dc
from diglot.llm import line_dedup as ld
from diglot.llm import member_filter as mf
from diglot.llm import near_dups as nd
from diglot.llm import words

LOWER = {i: i + 32 for i in range(65, 91)}
VOCAB = [f"{a}{b}{c}" for a in "bdkmnprst" for b in "aeiou" for c in ("", "n", "st", "lor", "ving")]


def sentence(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


# ---- lines ----


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, least):
    flat = sorted(((i is not None, i or 0, k), i, k, x.strip(" ").lower()) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= least)
    first, gone = {}, {}
    for place, i, k, x in flat:
        if x in first:
            gone[i, k] = first[x]
        else:
            near = [p for y, p in first.items() if abs(len(x) - len(y)) <= 1 and edits(x, y) == 1]
            if near:
                gone[i, k] = min(near)
            first[x] = place
    # a line that is equal to one that goes because of a near line goes because of that line too
    return set(gone)


def line_rows():
    r = random.Random(4)
    rows = []
    for i in range(60):
        rows.append([sentence(r, r.randint(3, 14)) for _ in range(r.randint(0, 6))])
    for _ in range(120):
        x = r.choice([y for y in rows if y])
        line = list(r.choice(x))
        at, kind = r.randrange(len(line)), r.randrange(4)
        if kind == 0:
            line[at] = "q"
        elif kind == 1:
            del line[at]
        elif kind == 2:
            line.insert(at, "z")
        r.choice(rows).append("".join(line))
    out = [(i, "\n".join(x)) for i, x in enumerate(rows)]
    counters = "\n".join(f"this is page number {i} of the whole long book" for i in range(40))
    return [*out, (100, None), (101, ""), (102, counters), (103, "A" * 33), (104, "a" * 34 + "\n" + "a" * 32), (105, "é" * 40 + "\n" + "é" * 39 + "x"), (106, " " * 50)]


@pytest.mark.parametrize("least", [10, 32])
def test_lines_agree_with_brute_force(spark, least):
    rows = line_rows()
    got = ld.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least)
    assert {(r.doc_id, r.line) for r in got.collect()} == brute_lines(rows, least)


def test_lines_by_document_and_cut_texts(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "x", len(t or ""), "y") for i, t in rows], "doc_id long, text string, source string, n_chars long, line string")
    gone = brute_lines(rows, 32)
    by = {r.doc_id: r for r in ld.by_document(docs, 32).collect()}
    assert set(by) == {i for i, _ in rows} and all(by[i].removed_lines == sorted(k for j, k in gone if j == i) for i, _ in rows)
    assert by[100].n_lines == 0 and by[102].n_lines == 40
    left = {r.doc_id: r for r in ld.without_repeats(docs).collect()}
    assert ld.without_repeats(docs).columns == docs.columns
    for i, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if any(j == i for j, _ in gone) and not kept.strip():
            assert i not in left
        else:
            assert left[i].text == kept and left[i].n_chars == len(kept or "")


def test_lines_of_nothing_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ld.by_document(none).count() == 0 and ld.without_repeats(none).count() == 0
    line = "this line is long enough to take part in it"
    some = spark.createDataFrame([(None, line), (1, line), (2, f"{line}\n{line}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in ld.by_document(some).collect()} == {None: 0, 1: 1, 2: 2}


def test_lines_of_every_length_take_part(spark):
    rows = [(1, "Short one.\n\na\n \t\nb"), (2, "short one. \n\nb\n \t\nc"), (3, "Short onex.\n12\n13"), (4, "A line of twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(2, 0): (1, 0), (2, 2): (1, 4), (3, 0): (1, 0)}
    assert {(r.doc_id, r.line): (r.of_doc_id, r.of_line) for r in ld.repeated_lines(docs, 10, every=True).collect()} == want
    left = {r.doc_id: r.text for r in ld.without_repeats(docs, 10, every=True).collect()}
    assert left == {1: rows[0][1], 2: "\n \t\nc", 3: "12\n13", 4: rows[3][1]}


def test_lines_a_word_apart_agree_with_brute_force(spark):
    r = random.Random(8)
    lines = [sentence(r, r.randint(6, 40)).split(" ") for _ in range(40)]
    for _ in range(120):
        line = list(r.choice(lines))
        for _ in range(r.randint(0, 2)):
            at, kind = r.randrange(len(line)), r.randrange(3)
            line[at : at + (kind < 2)] = [] if kind == 0 else ["quitelongerword"]
        lines.append(line)
    rows = [(i, "  ".join(x)) for i, x in enumerate(lines)]
    want = {}
    for i, a in enumerate(lines):
        texts = [" ".join(x) for x in lines[: i + 1]]
        near = [j for j, b in enumerate(lines[:i]) if a == b or (edits(texts[i], texts[j]) <= 1) or (min(len(a), len(b)) >= 10 and edits(a, b) <= 1)]
        if near:
            want[i] = near[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.of_doc_id for r in ld.repeated_lines(docs, 10, every=True, least_words=10).collect()}
    assert set(got) == set(want) and any(abs(len(rows[i][1]) - len(rows[j][1])) > 5 for i, j in want.items())


def test_a_false_first_partner_hides_no_true_one(spark, monkeypatch):
    """Words share four codes, so most texts first meet one that isn't a word apart."""
    r = random.Random(23)
    base = [sentence(r, 12).split(" ") for _ in range(4)]
    rows = []
    for k in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(12)] = r.choice(VOCAB[:4])
        if r.random() < 0.3:
            del w[r.randrange(12)]
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ld, "coded", lambda words: F.array_join(F.transform(words, lambda w: F.substring(F.lit("abcd"), F.pmod(F.xxhash64(w), F.lit(4)).cast("int") + 1, F.lit(1))), ""))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id for x in ld.repeated_lines(docs, 1000, True, 10).collect()}
    assert found == {i for i, t in rows if any(edits(t.split(" "), u.split(" ")) <= 1 for _, u in rows[:i])}


@pytest.mark.parametrize("a, b, want", [("", "", True), ("a", "", True), ("a b", "", False), ("a b c", "a c", True), ("a c", "a b c", True), ("a b c", "a x c", True), ("a b c", "b a c", False), ("a a b", "a b", True), ("a b", "a b c d", False), ("a b c d", "a c d b", False), ("x a b", "a b", True), ("a b", "a b x", True)])
def test_a_word_apart(spark, a, b, want):
    one = spark.range(1).select(ld.a_word_apart(ld.words_of(F.lit(a)), ld.words_of(F.lit(b))).alias("x"))
    assert one.first().x is want and (edits(a.split(), b.split()) <= 1) is want


def test_words_and_lines_are_cut_at_any_white_space(spark):
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "\ta", "a\t", "a\tb c", "a\x0bb", "a\fb", "a\rb\r", "\x1fa\u00a0b", "\u3000", " \t\x0b\f\r ", "!", "\x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.w for r in docs.select("doc_id", ld.words_of(F.col("text")).alias("w")).collect()}
    assert got == {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in enumerate(texts)}
    assert {r.doc_id for r in ld.lines_of(docs, every=True).collect()} == {i for i, w in got.items() if w}


def test_line_dedup_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ld.by_document(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- near copies ----


def bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    total = (a | b).total()
    return (a & b).total() / total if total else 0.0


def copy_rows():
    r = random.Random(9)
    rows = [sentence(r, r.randint(1, 120)) for _ in range(80)]
    for _ in range(120):
        w = r.choice(rows).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append(" ".join(w))
    hub = sentence(r, 100)
    rows += [hub.replace(" ", "  ", 1).upper() if k % 2 else hub for k in range(40)]
    rows += [" ".join(hub.split(" ")[:-1] + [f"tail{k}"]) for k in range(60)]
    rows += ["a b c d e f g " * 30, "a b c d e f g " * 29, "a b c d e f g " * 10, None, "", " \n", "one", "one", "One two"]
    return list(enumerate(rows))


def brute_classes(rows, least):
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(bags[i], bags[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_classes_agree_with_brute_force(spark):
    rows = copy_rows()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, bands string").repartition(3)
    got = {r.doc_id: r for r in nd.classes(docs).collect()}
    want = brute_classes(rows, 0.8)
    assert {i: r.class_id for i, r in got.items()} == want
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] and r.kept == (i == r.class_id) for i, r in got.items())
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_large_bands_are_split(spark):
    """Texts that share most of their words and aren't copies, with copies among them; groups of more than four are split."""
    r = random.Random(4)
    base = sentence(r, 100).split(" ")
    rows = []
    for k in range(40):
        w = list(base)
        for at in r.sample(range(100), 3):
            w[at] = f"own{k}x{at}"
        rows.append(" ".join(w))
    rows += [t + " end" for t in rows[::5]]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in nd.classes(docs, most_pairs=4).collect()} == brute_classes(rows, 0.8)


def one_family(spark, bands, copies):
    """Texts that aren't copies but for some, as documents and as sketches that share all the bands."""
    r = random.Random(11)
    base = sentence(r, 40)
    rows = [f"{base} {sentence(r, 40)}" for _ in range(30)]
    rows += [f"{rows[k]} end" for k in copies]
    # repeated shingles count, and a short text is one shingle
    rows += [f"{'a b c ' * 40}{k}" for k in range(4)] + [f"{'a b c ' * 20}{k}" for k in range(4)] + ["x y", "x z"]
    rows = list(enumerate(rows))
    sketches = [(i, i, bag(t).total(), list(range(100, 100 + bands))) for i, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(sketches, "doc_id long, exact long, n_shingles long, bands array<long>")


def test_a_large_band_loses_no_link(spark):
    """One band is all that the documents share, and the links don't end at its least one."""
    rows, docs, sketches = one_family(spark, 1, [5, 9, 9, 20])
    want = {i: k for i, k in brute_classes(rows, 0.8).items()}
    root = {r.node: r.root for r in cc.components(nd.links(docs, sketches, most_pairs=4)).collect()}
    assert {i: root.get(i, i) for i, _ in rows} == want and len(set(want.values())) == 34


def test_rounds_do_not_grow_with_shared_bands(spark, monkeypatch):
    rows, docs, sketches = one_family(spark, 6, [3])
    calls, overlaps = [], nd.overlaps
    monkeypatch.setattr(nd, "overlaps", lambda pairs, *rest: calls.append(pairs.count()) or overlaps(pairs, *rest))
    root = {r.node: r.root for r in cc.components(nd.links(docs, sketches, most_pairs=4)).collect()}
    assert {i: root.get(i, i) for i, _ in rows} == brute_classes(rows, 0.8)
    assert len(calls) <= 4 and sum(calls) <= 3 * len(rows)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_prefixes_meet_in_every_similar_pair(spark, least):
    rows = [(i, t) for i, t in copy_rows() if bag(t)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, root long, text string").repartition(3)
    at = {}
    for r in nd.prefixes(docs, least).collect():
        at.setdefault(r.doc_id, {})[r.element] = r.at
        assert r.n == bag(dict(rows)[r.doc_id]).total()
    for i, x in rows[60:]:
        for j, y in rows[60:]:
            if i < j and similar(bag(x), bag(y)) >= least:
                assert at.get(i, {}).keys() & at.get(j, {}).keys()


def test_classes_of_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(docs).count() == 0 and nd.keep_one(docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, nd.classes(twice).collect())) == [(1, 1, 2, True), (2, 1, 2, False)]


@pytest.mark.parametrize("most_pairs", [2, 128])
def test_every_text_of_a_repeated_id_is_linked(spark, most_pairs):
    """Ids with texts of different sizes, some of them empty; brute force over the texts, then over the ids."""
    r = random.Random(17)
    base = sentence(r, 60)
    own = [sentence(r, n) for n in (30, 200, 60, 90, 45, 120, 80, 25)] + [f"{base} {sentence(r, 30)}" for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(own)] + [(100 + k, t + " end") for k, t in enumerate(own)]
    rows += [(50, own[0] + " tail"), (50, own[1] + " tail"), (51, None), (51, own[2] + " tail"), (52, own[3]), (52, own[4]), (52, own[4])]
    rows += [(53, ""), (53, None), (101, own[9] + " more"), (110, own[5]), (111, sentence(r, 10))]
    root = {k: k for k, _ in rows}
    while True:
        known = dict(root)
        for i, t in rows:
            for j, u in rows:
                if i == j or similar(bag(t), bag(u)) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
        if root == known:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nd.classes(docs, most_pairs=most_pairs).collect()
    assert {x.doc_id: x.class_id for x in got} == root and len(got) == len(root)


def test_bagminhash_is_unbiased():
    r, gaps = np.random.default_rng(0), []
    for t in range(40):
        a = r.integers(0, 9, 30)
        b = np.maximum(0, a + r.integers(-2, 3, 30))
        s = words.mix(np.arange(30, dtype=np.uint64) + np.uint64(1000 * t)) >> np.uint64(16)
        x, y = np.flatnonzero(a), np.flatnonzero(b)
        sig = nd.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([s[x], s[y]]), np.concatenate([a[x], b[y]]), 2, 400)
        gaps.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.05


def test_overlap():
    texts = ["a b c d e f", "a b", "", None, "a a a a a a a", "a b c d e f g"]
    other = ["a b c d e f g", "A B", "", None, "a a a a a a", "x y z"]
    want = [similar(bag(x), bag(y)) for x, y in zip(texts, other)]
    assert nd.overlap(pa.array(texts), pa.array(other)).tolist() == pytest.approx(want)


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(50)] + [(1000, k) for k in range(1001, 1400)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7000, 7000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {row.node: row.root for row in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 7000}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_member_filter_misses_nothing(spark):
    ids = spark.range(0, 20000, 7).select(F.col("id").alias("x"))
    some = spark.range(0, 20000).where(mf.maybe_in(ids, "x")(F.col("id")))
    assert ids.join(some, ids.x == some.id).count() == ids.count() and some.count() < 1.05 * ids.count()
    assert spark.range(10).where(mf.maybe_in(ids.limit(0), "x")(F.col("id"))).count() == 0


# ---- decontamination ----


def least_edits(item, text):
    """Edits from the whole item to the best run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def contaminated():
    r = random.Random(6)
    items = [(k, sentence(r, n)) for k, n in enumerate([14, 20, 31, 45, 59, 6, 3])] + [(7, None), (8, "")]
    docs = []
    for i in range(150):
        w = sentence(r, r.randint(0, 150)).split(" ")
        if i % 3 == 0:
            item = r.choice(items[:7])[1].split(" ")
            for _ in range(r.randint(0, len(item) // 4)):
                at, kind = r.randrange(len(item)), r.randrange(3)
                if kind == 0:
                    item[at] = r.choice(VOCAB)
                elif kind == 1 and len(item) > 1:
                    del item[at]
                else:
                    item.insert(at, r.choice(VOCAB))
            at = r.randint(0, len(w))
            w[at:at] = item
        docs.append((i, " ".join(w)))
    return items, [*docs, (900, None), (901, ""), (902, items[0][1].upper()), (902, items[0][1])]


def test_search_agrees_with_brute_force(spark):
    items, docs = contaminated()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    want = {}
    for i, t in docs:
        for k, x in items:
            n = len(split(x))
            if n and (e := least_edits(split(x), split(t))) <= n // 5:
                want[i, k] = e
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.search(d, b).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert {k for k, e in want.items() if e == 0} <= set(got) and len(got) >= 0.97 * len(want)
    assert sum(r.doc_id == 902 and r.item_id == 0 for r in rows) == 2
    left = dc.remove(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    # one group or many, the same rows
    assert sorted(map(tuple, dc.search(d, b, most_bytes=300).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize(("n", "tables"), [(20, None), (20, {20: 0}), (60, None), (100, None), (200, None)])
def test_recall_at_the_full_bound_by_length(n, tables):
    """Items at n // 5 edits inside longer texts; repeated items are found together."""
    r = np.random.default_rng(n)
    items = [" ".join(f"w{x}" for x in r.integers(0, 5000, n)) for _ in range(60 if n < 100 else 30)]
    texts = []
    for t in items:
        w = t.split(" ")
        for _ in range(n // 5):
            at, kind = int(r.integers(len(w))), r.integers(3)
            w[at : at + int(kind != 2)] = [] if kind == 1 else [f"new{r.integers(1 << 30)}"]
        texts.append(" ".join([*(f"v{x}" for x in r.integers(0, 5000, 50)), *w, *(f"v{x}" for x in r.integers(0, 5000, 50))]))
    index = dc.Index([*range(len(items)), 999], [*items, items[0]], tables or dc.planned(items, 0.98))
    assert len(index.items) == len(items) and index.ids[0] == [0, 999]
    found = index.matches(pa.array(texts))
    assert all(a == b for a, b in found) and len(found) >= (1.0 if tables else 0.93) * len(items)


def test_long_texts_and_many_equal_keys():
    item = "one two three four five six seven eight nine ten"
    index = dc.Index([1], [item], {10: 1})
    text = " ".join(["pad"] * 5_000 + [item] + ["pad"] * 5_000 + [item + " x"] * 300)
    assert index.matches(pa.array([text, None, ""])) == {(0, 0): (0, 10, 5_000, 5_010)}


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.search(none, items).count() == 0 and dc.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
    assert dc.remove(none, items).count() == 0


def test_edit_distance_to_a_prefix():
    a = np.arange(10, dtype=np.uint64)
    pad = lambda x: np.concatenate([x, np.full(12, dc._END, np.uint64)])[:12]
    edits, used = dc.edit_distances(np.tile(a, (4, 1)), np.stack([pad(np.concatenate([a, a])), pad(np.delete(a, 4)), pad(a[::-1].copy()), pad(a[:9])]), 2)
    assert edits.tolist() == [0, 1, 3, 1] and used[:2].tolist() == [10, 9] and used[3] == 9


def test_pieces_leave_no_match_out():
    for n in range(1, 80):
        p = dc.pieces(n)
        assert len(p) == dc.bound(n) + 1 and p[0][0] == 0 and p[-1][1] == n and all(b > a for a, b in p)


def test_half_keys_are_shuffled_once_and_the_filter_reads_numbers(spark, monkeypatch):
    plans, write = {}, ld.materialise

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(ld, "materialise", kept)
    rows = [(i, f"line number {i} of a few that are all alike\nand one of all") for i in range(40)]
    assert ld.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, every=True, least_words=10).count() == 39 + 39
    assert plans["line-keys"].count("Exchange hashpartitioning(half") == 1 and "conv(" not in plans["line-halves"].split("Subquery")[0]
    keys = [0, 1, -1, 7, 8, 63, 64, 32767, 32768, (1 << 26) - 1, 1 << 26, 5 << 40, -(1 << 63), (1 << 63) - 1]
    near = sorted({k + d for k in keys for d in range(-70, 71) if -(1 << 63) <= k + d < 1 << 63})
    test = ld.in_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    got = spark.createDataFrame([(k,) for k in [*near, None]], "key long").select("key", test(F.col("key")).alias("hit")).collect()
    bits = {k % (1 << 26) for k in keys}
    assert all(r.hit == (r.key is not None and r.key % (1 << 26) in bits) for r in got)
