"""The same measures for Python code inside Arrow functions; tests hold them against the columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property

_HAN = re.compile("[一-鿿]")
_ROMAN = re.compile("[A-Za-zİK]")
_HANS, _ROMANS = re.compile(_HAN.pattern + "+"), re.compile(_ROMAN.pattern + "+")
_TO_LETTERS = {c: None for c in range(128) if not chr(c).isalpha()}
_QUOTES = {ord(a): b for a, b in zip("‘’“” ", "''\"\" ", strict=True)} | {0x200B: None}
_ASIDE, _WIDE_ASIDE = re.compile("[(][^)]*[)]"), re.compile("（[^）]*）")
_CITED, _FIGURE = re.compile("\\s*[\\[]([0-9]+)[\\]]"), re.compile("\\s*图\\s*([0-9.]+)")
_AUTHOR, _ASCII_MARKS = re.compile("作者[：:]"), {ord(c): None for c in "'\"().,:;"}
_MARKS = re.compile("[\\s'\"“”()《》·．。.,，、:：;；]")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def norm(text: str | None) -> str:
    return squeeze((text or "").translate(_QUOTES))


def counts(t: str) -> tuple[int, int]:
    """CJK characters and Latin letters."""
    if t.isascii():
        return 0, len(t.translate(_TO_LETTERS))
    return sum(map(len, _HANS.findall(t))), sum(map(len, _ROMANS.findall(t)))


def skipped(text: str) -> bool:
    t = norm(text)
    cjk, letters = counts(t)
    return len(t) < 2 or t.startswith(("http", "www.", "doi:")) or cjk >= 2 or letters < 3


def is_title(text: str) -> bool:
    t = norm(text)
    cjk, letters = counts(t)
    return len(t) >= 2 and not cjk and letters >= 2 and not t.startswith("http") and not t.endswith((".html", ".xhtml"))


def chinese(text: str) -> bool:
    if text.isascii():
        return not _ROMAN.search(text)
    cjk, letters = counts(text)
    return cjk >= letters


def duplicate_key(text: str) -> str:
    # all white space goes, that between 第 and 章 too
    t = "".join((_AUTHOR.sub("", text) if "作者" in text else text).split())
    return (t.translate(_ASCII_MARKS) if t.isascii() else _MARKS.sub("", t)).lower()


def core(text: str) -> str:
    return duplicate_key(_ASIDE.sub("", _WIDE_ASIDE.sub("", squeeze(text))))


def _lead(pattern: re.Pattern, text: str) -> str | None:
    return found[1] if (found := pattern.match(text)) else None


class Shape:
    """What two texts are compared by, worked out once for each, when it is asked for."""

    def __init__(self, text: str):
        self.text = text

    key = cached_property(lambda self: duplicate_key(self.text))
    chinese = cached_property(lambda self: chinese(self.text))
    core = cached_property(lambda self: core(self.text))
    cite = cached_property(lambda self: _lead(_CITED, self.text))
    figure = cached_property(lambda self: _lead(_FIGURE, self.text))

    def same(self, other: Shape) -> bool:
        """Equal, or equal by the key."""
        return self.text == other.text or (self.key != "" and self.key == other.key)

    def like(self, other: Shape) -> bool:
        """Copies, or an original and its translation; texts of one language must be copies."""
        if not self.text or not other.text:
            return False
        if self.same(other):
            return True
        if self.chinese == other.chinese:
            return False
        if (self.cite and self.cite == other.cite) or (self.figure and self.figure == other.figure):
            return True
        if len(self.core) >= 8 and self.core == other.core:
            return True
        short, long = sorted((self.key, other.key), key=len)
        if len(short) >= 18 and short[:18] == long[:18]:
            return True
        return len(short) >= 16 and short in long


def better(kept: str, new: str) -> str:
    """The text with more than two more CJK characters, else the longer one, else the one kept."""
    a, b = counts(kept)[0], counts(new)[0]
    if abs(a - b) > 2:
        return new if b > a else kept
    return new if len(new) > len(kept) else kept


def surplus(texts: list[str], cells: Iterable[bool]) -> list[int]:
    """Places of the blocks to drop: in each run of copies one English and the best Chinese text stay.

    A run begins at a block and takes the following ones that are like its first, or the same as any
    other member; cells end runs and never go. Of equal Chinese texts the last stays.
    """
    cells = list(cells)
    shapes = [Shape(t) for t in texts]
    out: list[int] = []
    at = 0
    while at < len(texts):
        end = at + 1
        if not cells[at]:
            while end < len(texts) and not cells[end] and (shapes[at].like(shapes[end]) or any(shapes[k].same(shapes[end]) for k in range(at + 1, end))):
                end += 1
        if end - at > 1:
            english = chinese_ = None
            for k in range(at, end):
                cjk, letters = counts(texts[k])
                if not cjk and letters >= 6:
                    english = k if english is None else english
                elif chinese_ is None or better(texts[chinese_], texts[k]) == texts[k]:
                    chinese_ = k
            stay = {k for k in (english, chinese_) if k is not None} or {at}
            out += [k for k in range(at, end) if k not in stay]
        at = end
    return out


_ITEM = re.compile(r"(?:[-+*•]\s+)?(?P<em>\*\*?|__)?(?:第\s*)?(?P<n>[0-9]{1,3})\s*段?\s*(?:[、．.)）：]|:(?=\s|$))(?P<close>\*\*?|__)?\s*(?P<rest>.*)$")


Items = dict[int, str]


def unwrapped(text: str) -> str:
    """See `functions.reply.unwrapped`."""
    return text.strip('"“”') if len(text) > 1 and text[0] in '"“”' and text[-1] in '"“”' else text


def reply_items(raw: str | None, most: int | None = None, quotes: Callable[[str], str] = lambda t: t.strip('"“”')) -> Items:
    """The items of a numbered reply; see `functions.reply.items`."""
    last, found = None, {}
    for line in filter(None, map(str.strip, (raw or "").splitlines())):
        m = _ITEM.match(line)
        n = int(m["n"]) if m else None
        if n is not None and (last is None or n > last) and (most is None or n <= most):
            rest = m["rest"] if m["close"] is None or m["close"] == m["em"] else m["close"] + m["rest"]
            found[last := n] = [rest.strip()]
        elif last is not None:
            found[last].append(line)
    return {k: quotes(" ".join(v).strip()) for k, v in found.items()}


def source_only(text: str) -> bool:
    """English, or mostly English with some Chinese."""
    cjk, letters = counts(text)
    return letters >= 8 if not cjk else letters >= 20 and cjk < 0.25 * (cjk + letters)
