"""Bytes to text with declared, marked or guessed encodings."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: declared names that stand for a wider encoding
WIDER = {n: wide for wide, many in {"gbk": "gb2312 gb-2312", "cp1252": "iso-8859-1 iso8859-1 latin-1 latin1 windows-1252", "ascii": "us-ascii", "utf-16": "ucs-2 ucs2"}.items() for n in many.split()}
_XML = re.compile(rb"<\?xml[^>]*?encoding=[\"']([\w.\-]+)[\"']", re.I)
_META = re.compile(rb"<meta(?=[\s/])[^<>]*?charset\s*=[\s\"']*([\w.\-]+)", re.I)


def declared(raw: bytes) -> str | None:
    """The encoding that an XML declaration or else a meta element names, in its wider form."""
    hit = _XML.search(raw[:1024]) or _META.search(raw[:2048])
    name = hit[1].decode("ascii", "replace").lower() if hit else None
    return WIDER.get(name, name)


def wide_order(raw: bytes) -> str | None:
    """Which UTF-16 a text without a mark is, by where most of its zero bytes lie."""
    even, odd = raw[:2048:2].count(0), raw[1:2048:2].count(0)
    return "utf-16-le" if odd > 2 * even else "utf-16-be" if even > 2 * odd else None


def to_text(raw: bytes | None) -> str:
    """The text of any bytes; what can't be decoded becomes U+FFFD."""
    raw = bytes(raw or b"")
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (b"<\x00", "utf-16-le"), (b"\x00<", "utf-16-be")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    name = declared(raw)
    if name == "utf-16" and (order := wide_order(raw)):
        return raw.decode(order, "replace")
    # nearly any bytes pass as Latin text, so UTF-8 is tried first there
    for attempt in (["utf-8"] if name in ("cp1252", "ascii") else []) + ([name] if name and name != "utf-16" else []) + ["utf-8"]:
        try:
            return raw.decode(attempt)
        except (LookupError, ValueError):
            continue
    return raw.decode("utf-8", "replace")


def damage(text: str) -> int:
    return text.count("�") + text.count("\0")


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("bad", T.IntegerType()), T.StructField("warn", T.BooleanType())])


@F.pandas_udf(DECODED)
def decoded(raw: pd.Series) -> pd.DataFrame:
    """Text of a binary column, its damaged characters, and whether they are more than one in a hundred."""
    texts = [to_text(r) for r in raw]
    bad = [damage(t) for t in texts]
    return pd.DataFrame({"text": texts, "bad": bad, "warn": [b > 0.01 * len(t) for t, b in zip(texts, bad, strict=True)]})
