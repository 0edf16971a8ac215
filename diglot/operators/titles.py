"""Titles left in English: finding them, and putting translations in their place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import plain
from diglot.functions import text as tx
from diglot.operators import html as ht

NAMED = ht.HEADINGS | frozenset("text title navlabel".split())
IN_CONTENTS = frozenset("span li a".split())


def is_contents(path: Column | str) -> Column:
    """Whether a path is taken for a table of contents: 'toc' or 'nav' anywhere in it, or an NCX file."""
    c = F.lower(tx.column(path))
    return c.contains("toc") | c.contains("nav") | c.endswith(".ncx")


def _contents(path: str) -> bool:
    low = path.lower()
    return "toc" in low or "nav" in low or low.endswith(".ncx")


def candidates(root: ht.Node, contents: bool) -> list[ht.Node]:
    """The elements whose text may be a title."""
    return [x for x in root.elements() if x.name in NAMED or (contents and x.name in IN_CONTENTS)]


def titles_in(text: str | None, path: str) -> list[str]:
    """The English titles of one document, in order."""
    contents, out, root = _contents(path), [], ht.parse(text)
    after = ht.successors(root)
    for x in candidates(root, contents):
        t = plain.norm(x.text())
        holds = x.name in ("li", "div") and x.has(frozenset("h1 h2 h3 h4 p a".split()))
        if not t or (holds and len(t) > 80) or (x.name in IN_CONTENTS | {"text"} and len(t) > 120):
            continue
        if plain.is_title(t) and (contents or not x.has_translation(after.get(id(x)))):
            out.append(t)
    return out


def collect(docs: DataFrame, book: str, path: str, order: str, text: str) -> DataFrame:
    """book, title, ord: each English title of a book once, numbered as first seen."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, o, k, t) for b, p, o, x in zip(f[book], f[path], f[order], f[text], strict=True) for k, t in enumerate(titles_in(x, p))]
            yield pd.DataFrame(rows, columns=[book, "member", "node", "title"])

    found = docs.select(book, path, order, text).mapInPandas(run, f"`{book}` string, member int, node int, title string")
    return distinct(found, book, ["member", "node"])


def distinct(found: DataFrame, book: str, order: list[str]) -> DataFrame:
    """Each title of a book at its first place. The minimum is taken before the shuffle."""
    first = found.groupBy(book, "title").agg(F.min(F.struct(*order)).alias("at"))
    return first.select(book, "title", F.row_number().over(Window.partitionBy(book).orderBy("at")).alias("ord"))


def put(x: ht.Node, new: str) -> None:
    """New text for an element; a navLabel keeps its inner text element."""
    if x.name == "navlabel":
        inner = next((k for k in x.kids if isinstance(k, ht.Node) and k.name == "text"), None)
        if inner is None:
            inner = ht.Node("text", {}, x)
            x.kids = [inner]
        x = inner
    x.put_text(new)


def replace_one(x: ht.Node, mapping: dict[str, str]) -> bool:
    """Puts a title's translation into an element; links inside it stay and take it themselves."""
    full = plain.norm(x.text())
    new = mapping.get(full)
    anchors = [a for a in x.elements() if a.name == "a"]
    if new is not None and (x.name == "a" or not anchors):
        put(x, new)
        return True
    if new is not None:
        hits = [(a, mapping[t]) for a in anchors if (t := plain.norm(a.text())) in mapping]
        for a, value in hits:
            put(a, value)
        if hits:
            return True
    for k in x.kids:
        if isinstance(k, ht.Text) and k.kind == "text" and plain.norm(k.value) in mapping:
            bare = k.value.strip()
            begin = k.value.index(bare)
            k.value = k.value[:begin] + mapping[plain.norm(bare)] + k.value[begin + len(bare) :]
            return True
    return False


def apply(text: str | None, path: str, mapping: dict[str, str]) -> tuple[str, int]:
    """A document with its titles replaced, and how many were. mapping: normalised title -> translation."""
    root, contents, done = ht.parse(text), _contents(path), 0
    after = ht.successors(root)
    for x in candidates(root, contents):
        t = plain.norm(x.text())
        cjk, letters = plain.counts(t)
        if not cjk and letters >= 2 and t in mapping and (contents or not x.has_translation(after.get(id(x)))):
            done += replace_one(x, mapping)
    return (ht.render(root) if done else text or ""), done


def applied(docs: DataFrame, book: str, path: str, text: str, mapping: DataFrame) -> DataFrame:
    """docs with titles replaced and `replaced`, from a table book, title, translation: each document is given its book's titles."""
    from pyspark.sql import types as T

    titles, values, columns = _fresh(docs, "titles"), _fresh(docs, "values"), docs.columns
    per = mapping.groupBy(F.col("book").alias(book)).agg(F.collect_list(F.struct("title", "translation")).alias("z")).select(book, F.col("z.title").alias(titles), F.col("z.translation").alias(values))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = [{} if t is None else dict(zip(map(plain.norm, t), v, strict=True)) for t, v in zip(f[titles], f[values], strict=True)]
            done = [apply(x, p, k) for x, p, k in zip(f[text], f[path], known, strict=True)]
            yield f[columns].assign(**{text: [d[0] for d in done], "replaced": [d[1] for d in done]})

    return docs.join(per, book, "left").select(*docs.columns, titles, values).mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField("replaced", T.IntegerType())]))


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


Marks = list[tuple[str, str]]


def protect_html(text: str | None, terms: Marks) -> tuple[str, Marks]:
    """A document with glossary terms as placeholders outside code, pre and sup; numbers run on over the whole document.

    terms: (pattern, target), in the order in which they are tried; see `functions.glossary`.
    """
    import re

    root, mapping = ht.parse(text), []
    seen = root.visible()
    tried = [(re.compile(p), t) for p, t in terms if re.search(p, seen)]
    for x in root.texts():
        if x.kind not in ("text", "raw") or x.parent.unseen:
            continue
        for p, target in tried:
            if p.search(x.value):
                mark = f"@@BT{len(mapping)}@@"
                x.value = p.sub(mark, x.value)
                mapping.append((mark, target))
    return ht.render(root), mapping
