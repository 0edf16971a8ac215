"""Package documents and tables of contents of one book, on the standard XML parser."""

from __future__ import annotations

import posixpath
import xml.etree.ElementTree as ET
from xml.parsers import expat
from xml.sax import saxutils

from diglot.functions import plain

PACKAGE, NCX, PAGE = "application/oebps-package+xml", "application/x-dtbncx+xml", "application/xhtml+xml"
DC_SPACE = "/".join(["http:", "", "purl.org", "dc", "elements", "1.1", ""])
DECLARED = "<?xml version=" + "'1.0' encoding='utf-8'?>\n"
NCX_SPACE, HTML_SPACE, OPS_SPACE = "http://" + "www.daisy.org/z3986/2005/ncx/", "http://" + "www.w3.org/1999/xhtml", "http://" + "www.idpf.org/2007/ops"


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def tree(text: str | None) -> ET.Element | None:
    """The root of a well-formed document, or None."""
    try:
        return ET.fromstring((text or "").lstrip("﻿ \r\n\t").encode())
    except ET.ParseError:
        return None


def named(root: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if root is None else [x for x in root.iter() if local(x.tag) == name]


def kids(el: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in el if local(x.tag) == name]


def words(el: ET.Element | None) -> str:
    return "" if el is None else plain.squeeze(" ".join(el.itertext()))


def slashed(path: str | None) -> str:
    return "/".join((path or "").split("\\"))


def clean(href: str | None) -> str:
    bare = slashed(href).partition("#")[0].strip()
    return posixpath.normpath(bare) if bare else ""


def resolve(package: str, href: str) -> str:
    href = clean(href)
    return href.lstrip("/") if not href or href.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(package), href))


def container_path(text: str | None) -> str | None:
    """The package path that a container names; entries that declare the package type come first."""
    files = named(tree(text), "rootfile")
    for el in sorted(files, key=lambda x: x.get("media-type") != PACKAGE):
        found = slashed(el.get("full-path")).strip()
        if found:
            return posixpath.normpath("/" + found)[1:]
    return None


def package_path(members: list[str], container: str | None) -> tuple[str | None, str | None]:
    """The book's package document and a warning: the declared one if it is there, else the first *.opf by name."""
    declared = container_path(container) if container is not None else None
    if declared in members:
        return declared, None
    found = sorted(m for m in members if m.lower().endswith(".opf"))
    if not found:
        return None, f"{declared} is missing" if declared else None
    return found[0], f"{declared} is missing" if declared else "no usable container"


class Package:
    """Manifest (id, href, media type, properties) and spine (ids) of a package document."""

    def __init__(self, text: str | None):
        root = tree(text)
        self.items, self.spine, self.toc = [], [], None
        for m in named(root, "manifest")[:1]:
            self.items = [(x.get("id"), clean(x.get("href")), x.get("media-type") or "", x.get("properties") or "") for x in m.iter() if local(x.tag) == "item"]
        for s in named(root, "spine")[:1]:
            self.toc = s.get("toc")
            self.spine = [x.get("idref") for x in s.iter() if local(x.tag) == "itemref" and x.get("idref")]
        self.title = next((t for t in map(words, named(root, "title")) if t), "")
        self.creator = next((t for t in map(words, named(root, "creator")) if t), "")

    @property
    def hrefs(self) -> dict[str, str]:
        """Manifest ids; the last of equal ids counts."""
        return {i: h for i, h, _, _ in self.items if i and h}

    def reading_order(self) -> list[str]:
        return [self.hrefs[i] for i in self.spine if i in self.hrefs]

    def ncx(self) -> str | None:
        """The table of contents: what the spine names, else the first item of its type."""
        return self.hrefs.get(self.toc or "") or next((h for _, h, kind, _ in self.items if kind == NCX and h), None)


class _Places:
    """Byte ranges of the elements of a document."""

    def __init__(self, raw: bytes):
        self.starts: list[tuple[str, dict[str, str], int]] = []
        self.ends: dict[str, tuple[int, str]] = {}
        parser = expat.ParserCreate()
        parser.StartElementHandler = lambda name, attrs: self.starts.append((name.rpartition(":")[2], attrs, parser.CurrentByteIndex))
        parser.EndElementHandler = lambda name: self.ends.setdefault(name.rpartition(":")[2], (parser.CurrentByteIndex, name))
        parser.Parse(raw, True)


def _insert(raw: bytes, tag: str, before: dict[str, str] | None, inside: str, line: str) -> bytes | None:
    """Puts a line before the first `tag` with these attributes, or at the end of element `inside`; None if there is no such place."""
    places = _Places(raw)
    for name, attrs, at in places.starts if before else []:
        if name == tag and all(attrs.get(k) == v for k, v in before.items()):
            return raw[:at] + line.encode() + raw[at:]
    if inside not in places.ends:
        return None
    at, full_name = places.ends[inside]
    if raw[at:].startswith(b"</" + full_name.encode()):
        return raw[:at] + line.encode() + raw[at:]
    # <manifest/>: open it
    begin = next(a for n, _, a in places.starts if n == inside)
    close = raw.index(b"/>", begin)
    full = raw[begin + 1 : close].split()[0]
    return raw[:close].rstrip() + b">" + line.encode() + b"</" + full + b">" + raw[close + 2 :]


def escaped(value: str) -> str:
    return saxutils.escape(value, {'"': "&quot;"})


def with_documents(text: str, dests: list[str], package: str, order: list[str]) -> tuple[str, list[str]]:
    """A package document with manifest and spine entries for all dests, and warnings.

    A new entry goes before the nearest later document (in `order`) that is there, else to the end.
    What is there isn't rewritten. A document that isn't well formed stays as it is.
    """
    raw, warnings = text.encode(), []
    base = posixpath.dirname(package) or "."
    to_href = lambda d: clean(posixpath.relpath(slashed(d), base))
    ranks = {h: i for i, h in reversed(list(enumerate(map(to_href, order))))}
    if tree(text) is None:
        return text, ["the package isn't well formed"]
    for dest in sorted(dests, key=lambda d: ranks.get(to_href(d), len(ranks))):
        now, href = Package(raw.decode()), to_href(dest)
        present = {h for h in now.reading_order() if h in ranks}
        after = min((h for h in present if ranks[h] > ranks.get(href, len(ranks))), key=ranks.get, default=None)
        ids = {h: i for i, h in reversed(now.hrefs.items())}
        name = ids.get(href)
        if name is None:
            name = wanted = "bt-" + "".join(c if c.isascii() and (c.isalnum() or c in "_.-") else "-" for c in slashed(dest))
            known = {i for i, *_ in now.items}
            n = 2
            while name in known:
                name, n = f"{wanted}-{n}", n + 1
            line = f'    <item href="{escaped(href)}" id="{escaped(name)}" media-type="{PAGE}"/>\n'
            new = _insert(raw, "item", {"id": ids[after]} if after in ids else None, "manifest", line)
            if new is None:
                warnings.append(f"no manifest for {href}")
            raw = new or raw
        if name not in now.spine:
            new = _insert(raw, "itemref", {"idref": ids[after]} if after in ids else None, "spine", f'    <itemref idref="{escaped(name)}"/>\n')
            if new is None:
                warnings.append(f"no spine for {href}")
            raw = new or raw
    return raw.decode(), warnings


# ---- tables of contents ----


def _text_child(el: ET.Element, space: str, value: str) -> None:
    child = next(iter(kids(el, "text")), None)
    if child is None:
        for x in list(el):
            el.remove(x)
        el.text = None
        child = ET.SubElement(el, space + "text")
    for x in list(child):
        child.remove(x)
    child.text = value


def points(nav: ET.Element) -> list[ET.Element]:
    """All entries in document order."""
    return [x for x in nav.iter() if local(x.tag) == "navPoint"]


def depth(nav: ET.Element) -> int:
    return max((1 + depth(p) for p in kids(nav, "navPoint")), default=0)


def _write(root: ET.Element) -> str:
    return ET.tostring(root, encoding="utf-8", xml_declaration=True).decode()


def repaired_ncx(text: str, title: str, author: str) -> str:
    """A table of contents with namespace, version, head, title, author, running numbers, wrapped labels and depth."""
    root = tree(text)
    if root is None or local(root.tag) != "ncx":
        return text
    if not root.tag.startswith("{"):
        for x in root.iter():
            x.tag = f"{{{NCX_SPACE}}}{x.tag}" if isinstance(x.tag, str) and not x.tag.startswith("{") else x.tag
    space = root.tag[: root.tag.index("}") + 1]
    ET.register_namespace("", space[1:-1])
    root.set("version", root.get("version") or "2005-1")
    ensure = lambda name: next(iter(kids(root, name)), None) if kids(root, name) else ET.SubElement(root, space + name)
    head, heading = ensure("head"), ensure("docTitle")
    if title or not words(heading):
        _text_child(heading, space, title or "目录")
    nav = next(iter(kids(root, "navMap")), None)
    if author:
        writer = next(iter(kids(root, "docAuthor")), None)
        if writer is None:
            writer = ET.Element(space + "docAuthor")
            root.insert(list(root).index(nav) if nav is not None else len(root), writer)
        if not words(writer):
            _text_child(writer, space, author)
    if nav is None:
        return _write(root)
    for i, p in enumerate(points(nav), 1):
        p.set("playOrder", str(i))
        for label in kids(p, "navLabel")[:1]:
            _text_child(label, space, words(label))
    meta = next((m for m in kids(head, "meta") if m.get("name") == "dtb:depth"), None)
    if meta is None:
        meta = ET.SubElement(head, space + "meta", {"name": "dtb:depth"})
    meta.set("content", str(depth(nav)))
    return _write(root)


def nav_page(ncx: str, title: str = "") -> str:
    """The table of contents as a page of nested ordered lists."""
    root = tree(ncx)
    nav = next(iter(kids(root, "navMap")), None) if root is not None else None

    def entries(at: ET.Element) -> str:
        out = []
        for p in kids(at, "navPoint"):
            target = next((c.get("src") for c in kids(p, "content")[:1] if c.get("src")), "#")
            label = words(next(iter(kids(p, "navLabel")), None)) or "未命名"
            below = entries(p) if kids(p, "navPoint") else ""
            out.append(f'<li><a href="{escaped(target)}">{escaped(label)}</a>{below}</li>')
        return "<ol>" + "".join(out) + "</ol>"

    name = escaped(title or "目录")
    inner = entries(nav) if nav is not None else ""
    return DECLARED + f'<html xmlns="{HTML_SPACE}" xmlns:epub="{OPS_SPACE}"><head><title>{name}</title></head><body><nav epub:type="toc" id="toc"><h1>{name}</h1>{inner}</nav></body></html>'


def with_nav(package: str, href: str) -> str:
    """A package document whose manifest has the nav page: the item that is one changes, else one is added."""
    root = tree(package)
    for manifest in named(root, "manifest")[:1]:
        items = kids(manifest, "item")
        item = next((x for x in items if "nav" in x.get("properties", "").split() or (x.get("href") or "").endswith("nav.xhtml")), None)
        if item is None:
            item = ET.SubElement(manifest, manifest.tag[: -len("manifest")] + "item", {"id": "nav"})
        item.set("href", href)
        item.set("media-type", PAGE)
        item.set("properties", " ".join(sorted({*item.get("properties", "").split(), "nav"})))
        ET.register_namespace("", root.tag[1 : root.tag.index("}")] if "}" in root.tag else "")
        ET.register_namespace("dc", DC_SPACE)
        return _write(root)
    return package
