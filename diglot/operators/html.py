"""HTML as a tree and as tables of nodes and blocks.

The tree is the one that a plain event parser gives: no end tags are implied, void elements close
themselves, an end tag closes the nearest open element of its name and is ignored if there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diglot.functions import plain
from diglot.functions import text as tx

HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
CELLS = frozenset({"th", "td"})
BLOCKS = HEADINGS | CELLS | frozenset("small p li blockquote".split())
UNSEEN = frozenset("pre sup code".split())
VOID = frozenset("wbr track source param meta link keygen input img hr frame embed col br basefont base area".split())
RAW = frozenset({"style", "script", "template"})


class Text:
    """A run of characters; kind is text, comment, declaration or raw (in a script or style)."""

    __slots__ = ("kind", "parent", "value")

    def __init__(self, value: str, kind: str, parent: Node):
        self.value, self.kind, self.parent = value, kind, parent


class Node:
    """An element; the root has no name. depth: the elements and the root above it. unseen: in an UNSEEN element, or one itself.

    Nothing here recurses: a page may nest as deep as it likes.
    """

    __slots__ = ("attrs", "depth", "kids", "name", "parent", "unseen")

    def __init__(self, name: str, attrs: dict[str, str | None], parent: Node | None):
        self.name, self.attrs, self.parent, self.kids = name, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = name in UNSEEN or (parent is not None and parent.unseen)

    def walk(self) -> Iterator[Node | Text]:
        """All that is below, in document order."""
        ahead = [iter(self.kids)]
        while ahead:
            kid = next(ahead[-1], None)
            if kid is None:
                ahead.pop()
                continue
            yield kid
            if isinstance(kid, Node):
                ahead.append(iter(kid.kids))

    def elements(self) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node))

    def has(self, names: frozenset[str]) -> bool:
        return any(x.name in names for x in self.elements())

    def up(self) -> Iterator[Node]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def texts(self) -> Iterator[Text]:
        return (x for x in self.walk() if isinstance(x, Text))

    def text(self) -> str:
        """The pieces of text, trimmed, with one space between them."""
        return " ".join(s for s in (x.value.strip() for x in self.texts() if x.kind == "text") if s)

    def visible(self) -> str:
        """All characters outside UNSEEN elements, normalised."""
        return plain.norm(" ".join(x.value for x in self.texts() if not x.parent.unseen))

    def following(self) -> Node | None:
        """The next sibling that is an element."""
        later = self.parent.kids[self.parent.kids.index(self) + 1 :] if self.parent else []
        return next((x for x in later if isinstance(x, Node)), None)

    def has_translation(self, after: Node | None | str = "look") -> bool:
        """Whether the next element has the same name and is Chinese. after: that element, if it is known."""
        after = self.following() if after == "look" else after
        if after is None or after.name != self.name:
            return False
        cjk, letters = plain.counts(plain.norm(after.text()))
        return cjk >= max(2, letters)

    def drop(self) -> None:
        self.parent.kids.remove(self)

    def free(self) -> None:
        """Takes the tree apart. Parents and kids are cycles, which stay in memory until Python looks for them."""
        ahead = [self]
        while ahead:
            at = ahead.pop()
            kids, at.kids = at.kids, []
            for kid in kids:
                kid.parent = None
                if isinstance(kid, Node):
                    ahead.append(kid)

    def put_text(self, value: str) -> None:
        self.kids = [Text(value, "text", self)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, list[Node]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open.setdefault(tag, []).append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        same = self.open.get(tag)
        if not same:
            return
        found = same[-1]
        while self.at is not found.parent:  # each element is closed once
            self.open[self.at.name].pop()
            self.at = self.at.parent

    def _add(self, value: str, kind: str) -> None:
        last = self.at.kids[-1] if self.at.kids else None
        if kind in ("text", "raw") and isinstance(last, Text) and last.kind == kind:
            last.value += value
        else:
            self.at.kids.append(Text(value, kind, self.at))

    def handle_data(self, data: str) -> None:
        self._add(data, "raw" if self.at.name in RAW else "text")

    def handle_comment(self, data: str) -> None:
        self._add(data, "comment")

    def handle_decl(self, decl: str) -> None:
        self._add(decl, "declaration")

    def handle_pi(self, data: str) -> None:
        self._add(data, "instruction")


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _rendered(text: Text) -> str:
    value = escape(text.value, quote=False) if text.kind == "text" else text.value
    return {"comment": "<!--{}-->", "declaration": "<!{}>", "instruction": "<?{}>"}.get(text.kind, "{}").format(value)


def _opening(node: Node) -> str:
    attrs = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.name}{attrs}/>" if node.name in VOID else f"<{node.name}{attrs}>" if node.name else ""


def render(node: Node | Text) -> str:
    if isinstance(node, Text):
        return _rendered(node)
    out, ahead = [_opening(node)], [(node, iter(node.kids))]
    while ahead:
        at, kids = ahead[-1]
        kid = next(kids, None)
        if kid is None:
            ahead.pop()
            if at.name and at.name not in VOID:
                out.append(f"</{at.name}>")
        elif isinstance(kid, Text):
            out.append(_rendered(kid))
        else:
            out.append(_opening(kid))
            ahead.append((kid, iter(() if kid.name in VOID else kid.kids)))
    return "".join(out)


def holders(root: Node, names: frozenset[str]) -> set[int]:
    """The ids of the elements that hold an element of these names: each is marked once, from below."""
    out: set[int] = set()
    for x in root.elements():
        at = x.parent if x.name in names else None
        while at is not None and id(at) not in out:
            out.add(id(at))
            at = at.parent
    return out


def successors(root: Node) -> dict[int, Node]:
    """The next sibling element of each element that has one."""
    out, last = {}, {}
    for x in root.elements():
        before = last.get(id(x.parent))
        if before is not None:
            out[id(before)] = x
        last[id(x.parent)] = x
    return out


def leaves(root: Node, names: frozenset[str] = BLOCKS) -> list[Node]:
    held = holders(root, names)
    return [x for x in root.elements() if x.name in names and id(x) not in held]


def body(root: Node) -> Node:
    return next((x for x in root.elements() if x.name == "body"), root)


def eligible(root: Node) -> list[Node]:
    """The leaf blocks to translate."""
    after = successors(root)
    return [x for x in leaves(root) if not plain.skipped(x.text()) and not x.has_translation(after.get(id(x)))]


# ---- rewriting one document ----


def dropped(gone: dict[int, Node]) -> None:
    """Takes elements out of their parents, each parent's list once."""
    for parent in {id(x.parent): x.parent for x in gone.values()}.values():
        parent.kids = [k for k in parent.kids if id(k) not in gone]


def collapse(html: str | None) -> tuple[str, int]:
    """A document without adjacent copies, and how many blocks went."""
    root = parse(html)
    nodes = [(x, plain.squeeze(x.text())) for x in leaves(body(root))]
    nodes = [(x, t) for x, t in nodes if len(t) >= 2]
    gone = plain.surplus([t for _, t in nodes], (x.name in CELLS for x, _ in nodes))
    out = {id(nodes[k][0]): nodes[k][0] for k in gone}
    dropped(out)
    done = (render(root) if gone else html or ""), len(gone)
    for x in (root, *out.values()):
        x.free()
    return done


def without_source(html: str | None) -> tuple[str, int]:
    """A document without the English blocks that are followed by their translation."""
    root = parse(html)
    names = BLOCKS | {"div"}
    top = body(root)
    nodes = sorted((x for x in top.elements() if x.name in names), key=lambda x: -x.depth)
    held, after = holders(top, names), successors(root)
    gone = 0
    for x in nodes:
        if x.name in HEADINGS | CELLS or (x.name == "div" and (id(x) in held and x.has(names))):
            continue
        if x.has_translation(after.get(id(x))) and plain.source_only(plain.squeeze(x.text())):
            x.drop()
            gone += 1
    done = (render(root) if gone else html or ""), gone
    for x in (root, *nodes):
        x.free()
    return done


def insert(html: str | None, translations: dict[int, str]) -> tuple[str, int]:
    """Puts translations after the eligible blocks with these numbers.

    Cells and items of ordered lists take theirs inside; other blocks are copied without their id. A
    translation that is empty, English or equal to its source is left out.
    """
    root = parse(html)
    done, placed = 0, {}
    for k, x in enumerate(eligible(root)):
        new = translations.get(k) or ""
        if not new or plain.norm(new) == plain.norm(x.text()) or plain.counts(new)[0] < 2:
            continue
        if x.name in CELLS or (x.name == "li" and x.parent.name == "ol"):
            x.kids += [Node("br", {}, x), Text(new, "text", x)]
        else:
            copy = Node(x.name, {a: v for a, v in x.attrs.items() if a != "id"}, x.parent)
            copy.put_text(new)
            placed.setdefault(id(x.parent), (x.parent, {}))[1][id(x)] = copy
        done += 1
    for parent, copies in placed.values():
        parent.kids = [y for k in parent.kids for y in ((k, copies[id(k)]) if id(k) in copies else (k,))]
    out = (render(root) if done else html or ""), done
    root.free()
    return out


# ---- tables ----

#: Elements of whole documents that go back to Spark at once, and documents that are rewritten at once.
ROWS, PAGES = 2000, 50
NODES = "node int, parent int, sib int, depth int, tag string, leaf boolean, in_body boolean, in_ol boolean, text string, visible string"


def _records(html: str | None) -> list[tuple]:
    root = parse(html)
    top = body(root)
    ids, before, inside = {id(root): -1}, {}, {id(root): top is root}
    held, after = holders(root, BLOCKS), successors(root)
    follows = {id(after[id(x)]): x.name for x in root.elements() if id(x) in after and x.name in BLOCKS and id(x) not in held}
    out = []
    for n, x in enumerate(root.elements()):
        ids[id(x)] = n
        block = x.name in BLOCKS
        inside[id(x)] = x is top or inside[id(x.parent)]
        sib = before[id(x.parent)] = before.get(id(x.parent), -1) + 1
        leaf = block and id(x) not in held
        # the text of each of many nested elements would be the page's once more
        text = x.text() if leaf or follows.get(id(x)) == x.name else None
        out.append((n, ids[id(x.parent)], sib, x.depth, x.name, leaf, inside[id(x.parent)], x.parent.name == "ol", text, x.visible() if leaf else None))
    root.free()
    return out


def nodes(docs: DataFrame, key: str, html_col: str) -> DataFrame:
    """One row for each element of each document: key and NODES. Leaf blocks have their text and visible text, and the element right after one its text.

    A task holds one document's tree and some ROWS rows, however many pages Spark hands it at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in NODES.split(", "))]
        for batch in batches:
            schema, rows = pa.schema([batch.schema.field(0), *fields]), []
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                rows += [(name, *r) for r in _records(batch.column(1)[k].as_py())]
                if rows and (len(rows) >= ROWS or k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, html_col).mapInArrow(run, f"`{key}` {kind}, {NODES}")


def followed(table: DataFrame, key: str) -> Column:
    """Whether the next sibling element has the same name and is Chinese. Needs all elements, in rows of `nodes`."""
    after = Window.partitionBy(key, "parent").orderBy("sib")
    # the window's rows carry the verdict, not counts or texts; normalising changes neither script's characters
    return F.coalesce((F.lead("tag").over(after) == F.col("tag")) & F.lead(tx.mostly_chinese("text")).over(after), F.lit(False))


def blocks(docs: DataFrame, key: str, html_col: str) -> DataFrame:
    """The leaf blocks of each document with text (normalised), visible text, has_translation and eligible."""
    table = nodes(docs, key, html_col)
    named = table.withColumn("has_translation", followed(table, key)).where("leaf")
    clean = named.withColumn("text", tx.norm("text"))
    return clean.withColumn("eligible", ~tx.skipped("text") & ~F.col("has_translation"))


def rewrite(docs: DataFrame, html_col: str, change: Callable[[str | None], tuple[str, int]], count: str) -> DataFrame:
    """docs with the html column rewritten and a column of how much was changed; other columns pass through."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES):
                some = batch.slice(k, PAGES)
                at = some.schema.get_field_index(html_col)
                htmls, counts = zip(*(change(h.as_py()) for h in some.column(at)), strict=True)
                columns = [pa.array(htmls, pa.string()) if i == at else c for i, c in enumerate(some.columns)]
                fields = [pa.field(html_col, pa.string()) if i == at else f for i, f in enumerate(some.schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], schema=pa.schema([*fields, pa.field(count, pa.int32())]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(count, T.IntegerType())]))
