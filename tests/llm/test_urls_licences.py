import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from diglot.llm import licences as lc
from diglot.llm import url_filter as uf

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    best = None
    for verdict, rule in uf.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def shape(x):
    if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", x):
        return "{n}"
    return "{x}" if re.fullmatch(r"[0-9a-fA-F-]{8,}", x) else "{s}" if len(x) > 32 else x


def brute(urls, strength=4.0):
    """The tree, level by level, on plain dictionaries."""
    rows = []
    for u in urls:
        host, path = plain_parts(u)
        rows.append([host, tuple(shape(x) for x in path.split("/") if x), "", plain_rule(host, path)[1]])
    for d in range(max(len(r[1]) for r in rows)):
        each = defaultdict(lambda: [0, 0, 0, Counter()])
        for host, segs, prefix, label in rows:
            if len(segs) > d:
                e = each[host, prefix, segs[d]]
                e[0] += 1
                e[1] += label == "allow"
                e[2] += label == "block"
                e[3][segs[d + 1] if len(segs) > d + 1 else "{end}"] += 1
        token = {}
        pools = defaultdict(list)
        for (host, prefix, _), e in each.items():
            pools[host, prefix].append(e)
        for (host, prefix, seg), (n, a, b, follows) in each.items():
            pool = pools[host, prefix]
            N, A, B = (sum(e[k] for e in pool) for k in range(3))
            kind = lambda x: x if x.startswith("{") or sum(x in e[3] for e in pool) > 1 else "{w}"
            own, every = Counter(), Counter()
            for x, k in follows.items():
                own[kind(x)] += k
            for e in pool:
                for x, k in e[3].items():
                    every[kind(x)] += k
            apart = sum(abs(own[k] / n - (every[k] - own[k]) / (N - n)) for k in every) / 2 if N > n else 9
            labels, others = a + b, A + B - a - b
            share = B / max(labels + others, 1)
            gap = abs(b / max(labels, 1) - (B - b) / max(others, 1))
            spread = (share * (1 - share) * (1 / max(labels, 1) + 1 / max(others, 1))) ** 0.5
            differs = labels >= 5 and others >= 5 and gap > 1.96 * spread and gap > 0
            merged = not differs and ((len(pool) >= 8 and n < 0.02 * N) or apart <= min(0.5, 0.1 + n**-0.5))
            token[host, prefix, seg] = seg if seg.startswith("{") or not merged else "*"
        for r in rows:
            if len(r[1]) > d:
                r[2] += "/" + token[r[0], r[2], r[1][d]]
    labels = Counter(r[3] for r in rows)
    overall = labels["block"] / max(labels["allow"] + labels["block"], 1)
    hosts, temps = defaultdict(Counter), defaultdict(Counter)
    for host, _, prefix, label in rows:
        hosts[host][label] += 1
        temps[host, prefix][label] += 1
    out = []
    for u, (host, _, prefix, label) in zip(urls, rows):
        h = (hosts[host]["block"] + strength * overall) / (hosts[host]["allow"] + hosts[host]["block"] + strength)
        t = temps[host, prefix]
        share = (t["block"] + strength * h) / (t["allow"] + t["block"] + strength)
        out.append((prefix, label or ("block" if share > 0.5 else "allow")))
    return out


def urls():
    out = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://x.org", "http://x.org/", "http://example.org/es/1", "http://notexample.org/es/1", "http://example.org/en/12", "http://b.com/de/x?q", "http://b.com/de#f", "a://b://c/d", "http://É.com/fr/1"]
    for i in range(60):
        out += [f"http://blog.shop.com/{lang}/{i}" for lang in ("fr", "de", "es", "en")] + [f"http://spam.com/de/item/{i}", f"http://spam.com/de2/item/{i}", f"http://q.net/u{i}/profile/{'a' * 40}/deadbeef{i}/x/y/z"]
    out += [f"http://wide.com/{'a' if i % 9 else 'b'}/{i if i % 9 else 'y'}/p{i}" for i in range(90)] + ["http://deep.com/" + "s/" * 300 + "t"] * 2
    return out + ["http://q.net/about"] * 3


def test_a_large_branch_isnt_its_own_sibling():
    got = dict(zip(urls(), (t for t, _ in brute(urls()))))
    assert got["http://wide.com/a/1/p1"].startswith("/a/{n}/") and got["http://wide.com/b/y/p0"].startswith("/b/y/")


def test_pages(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls())], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    for i, (u, (template, verdict)) in enumerate(zip(urls(), brute(urls()))):
        r = got[i]
        assert (r.host, r.path) == plain_parts(u) and r.rule == plain_rule(r.host, r.path)[0] and (r.template, r.verdict) == (template, verdict)


def test_the_tables_pages(spark, sf):
    from diglot.session import table

    pages = table(spark, sf, "pages")
    rows = pages.select("page_id", "url").collect()
    want = dict(zip([r.page_id for r in rows], brute([r.url for r in rows])))
    assert {r.page_id: (r.template, r.verdict) for r in uf.judge(pages).collect()} == want


def test_no_pages_and_no_python(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    judged = uf.judge(none)
    assert judged.count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code only"), ("a/b/y.py", "more code"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.py", "z"),
    ("d/e.py", "Text text\nThis work is licensed under the GNU General Public License, version 3.\nmore text here and so on for long"), ("d/f.py", "nothing"), ("top.py", None), ("g/h.py", ""), ("g/i.py", "released under this roof of mit people"), (None, "no path"),
]


def test_licences(spark):
    docs = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string, license string").repartition(3)
    got = {r.doc_id: r for r in lc.scan(docs).collect()}
    want = {0: ("MIT", "notice", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "notice", None), 4: ("Apache-2.0", "inherited", "a/b"), 5: ("GPL-3.0", "notice", None)}
    assert {i: (r.license, r.origin, r.from_dir) for i, r in got.items() if r.license} == want and len(got) == len(FILES)
    assert got[5].line == 1 and got[5].score == pytest.approx(1.0)
    assert lc.scan(docs.limit(0)).count() == 0


def test_every_template_finds_itself(spark):
    flat = [(n, t) for n in sorted(lc.TEMPLATES) for t in lc.TEMPLATES[n]]
    docs = spark.createDataFrame([(i, f"p/{i}", "Some first line\n" + t.upper() + "\nlast line") for i, (_, t) in enumerate(flat)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in lc.notices(docs).collect()}
    assert got == {i: n for i, (n, _) in enumerate(flat)}


def test_notices_across_lines_and_inside_them(spark):
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    prose = "Some words of a long story that goes on, "
    files = [
        ("a/LICENSE", wrap(lc.MIT_TEXT, 9)), ("a/x.py", "code only"), ("b/y.py", prose * 3 + "\n" + wrap(lc.APACHE_HEADER, 11) + "\n" + prose * 20), ("b/z.py", "z"),
        ("c/p.txt", prose * 2 + "This work is licensed under the GNU General Public License, version 3. " + prose * 2), ("c/q.txt", "this work is\nlicensed under the GNU\nGeneral Public License, version 2."), ("d/n.txt", prose * 9), ("d/e.txt", None),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.line) for r in lc.scan(docs).collect() if r.license}
    assert got == {0: ("MIT", "notice", 0), 1: ("MIT", "inherited", None), 2: ("Apache-2.0", "notice", 1), 4: ("GPL-3.0", "notice", 0), 5: ("GPL-2.0", "notice", 0)}


def test_common_forms_of_notices(spark):
    comment = lambda t, mark: "\n".join(f"{mark} " + " ".join(t.split()[i : i + 10]) for i in range(0, len(t.split()), 10))
    wanted = [
        ("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
        ("MIT", lc.MIT_GRANT), ("MIT", "The MIT License (MIT)"), ("GPL-3.0", comment(lc.GNU_GRANT.format(what="program", kind="", n=3), "#")), ("GPL-2.0", comment(lc.GNU_HEADER.format(what="file", kind="", n=2), "//")),
        ("Apache-2.0", "/*\n" + comment(lc.APACHE_HEADER, " *") + "\n */\nint x;"), ("BSD-3-Clause", "Copyright (c) 2020, Ann\n\n" + lc.BSD_3 + "\n" + lc.BSD_END), ("GPL-3.0", lc.HEADS["GPL-3.0"][0] + "\n" + "word " * 3000),
    ]
    docs = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(wanted)] + [(100 + i, f"d{i}/g", "int main") for i in range(len(wanted))], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in lc.scan(docs).collect()}
    assert {i: got[i] for i in range(len(wanted))} == {i: (n, "notice") for i, (n, _) in enumerate(wanted)}
    assert got[109] == ("GPL-3.0", "inherited") and got[108] == ("BSD-3-Clause", "inherited")


def test_cosines_agree_with_brute_force():
    import math
    import random

    r = random.Random(8)
    flat = [(n, t) for n in sorted(lc.TEMPLATES) for t in lc.TEMPLATES[n]]
    split = lambda t: t.lower().split()
    vocabulary = sorted({w for _, t in flat for w in split(t)})
    documents = 500
    v0 = lc.Vectors(lc.TEMPLATES)
    having = {w: r.randrange(documents) for w in vocabulary}
    by_hash = {int(lc.words.split(lc.pa.array([w])).hash[0]): having[w] for w in vocabulary}
    v = lc.Vectors(lc.TEMPLATES, documents, lc.np.array([by_hash[int(h)] for h in v0.vocabulary]))
    idf = lambda w: math.log((1 + documents) / (1 + having.get(w, 0))) + 1

    def cosine(a, b):
        x, y = Counter(split(a)), Counter(split(b))
        norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
        return sum(x[w] * y[w] * idf(w) ** 2 for w in x) / (norm(x) * norm(y))

    lines = [" ".join(r.sample(split(r.choice(flat)[1]) * 2 + ["other", "words"] * 3, 6)) for _ in range(60)] + [t for _, t in flat]
    w = lc.words.split(lc.pa.array(lines), lower=True)
    best, score = v.cosines(v.places(w.hash), w.hash, w.row, len(lines))
    for line, k, s in zip(lines, best, score):
        want = [cosine(line, t) for _, t in flat]
        assert s == pytest.approx(max(want)) and want[k] == pytest.approx(s)


def test_ancestors(spark):
    df = spark.createDataFrame([("a/b",), ("",)], "d string").select(lc.ancestors(F.col("d")).alias("x"))
    assert [[tuple(a) for a in r.x] for r in df.collect()] == [[("", 0), ("a", 1), ("a/b", 2)], [("", 0)]]
