"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces.

A BPE tokenizer cuts a text into words before it merges. Where a cut is certain (a single space
between two visible characters, or a newline between them) the parts are encoded once and their ids
joined, which gives the ids of the whole text. Texts in which a cut isn't certain, and tokenizer
files of an unknown kind, are encoded whole. Strings of special tokens in a text are ordinary text.

Texts are cut, their distinct pieces found and looked up, and the ids of all texts gathered as Arrow columns; a Python
string is made of a piece that is met for the first time only.
"""

from __future__ import annotations

import ctypes
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# the white space of Python's \s other than space and newline, and runs of white space, also at the ends
_OTHER = r"\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = rf"[{_OTHER}]|[ \n][ \n]|^[ \n]|[ \n]$"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = "!#$%&*+,-./:;<=>?@^_|~"
_LETTERS = r"^\p{L}+$"
# letters that normal forms or lower case turn into a letter and a mark, with some neighbours that they don't
_UNSURE = r"[\x{130}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{f69}\x{fb1d}-\x{fb4e}]"
_NONE = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
_encoders: dict[tuple[str, int], Encoder] = {}


def _layout(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The offsets and bytes of a large string or binary column."""
    held = column.buffers()
    return np.frombuffer(held[1], np.int64)[column.offset : column.offset + len(column) + 1], held[2] or pa.py_buffer(b"")


def _column(kind: pa.DataType, offsets: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"" if pa.types.is_large_binary(parts[0].type) else "", parts[0].type))


class Encoder:
    """Encodes texts with the tokenizer in a file; most_cached bounds the pieces kept (about 40 bytes each, as many again at a lookup).

    A piece is a word of a text. With a tokenizer of bytes its first character tells what is before it: \\r
    nothing, \\n a newline, else a space. Two tables hold the pieces met of late and those met before; when the
    first has most_cached / 2 it takes the place of the second. The pieces of one call are held beyond that.
    """

    def __init__(self, path: str, most_cached: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self.kind = self._kind(json.loads(self._tok.to_str()))
        self.vocab = self._tok.get_vocab_size()
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self.most_cached = most_cached
        self._new = self._old = _NONE
        self._newline = self._ids(["\n"])[0]
        self._mark = {"byte": "\n", "word": "|"}.get(self.kind)
        known = np.frombuffer(self._ids([self._mark])[0], self.dtype) if self._mark else []
        self._mark_id = known[0] if len(known) == 1 else None

    @staticmethod
    def _kind(spec: dict) -> str:
        norm, cut, post = spec.get("normalizer"), spec.get("pre_tokenizer"), spec.get("post_processor")
        added = [t for t in spec.get("added_tokens", []) if not t.get("special")]
        if added or spec.get("truncation") or spec.get("padding"):
            return "whole"
        if norm is None and cut and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            return "byte"
        names = [x["type"] for x in (norm or {}).get("normalizers", [])]
        steps = [x["type"] for x in (cut or {}).get("pretokenizers", [])]
        if names == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and (post is None or post.get("type") in ("RobertaProcessing", "ByteLevel", "TemplateProcessing")):
            return "word"
        return "whole"

    def _ids(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self._tok, "encode_batch_fast", self._tok.encode_batch)
        return [np.array(e.ids, self.dtype).tobytes() for e in batch(texts, add_special_tokens=False)]
    def _words(self, words: list[str], lead: str) -> pa.Array:
        """The ids of words of letters, encoded by the hundred with a mark between them that is a token of its own."""
        if self._mark_id is None or not words:
            return pa.array(self._ids([lead + w for w in words]), pa.large_binary())
        glue, step = self._mark + lead, 256
        batch = getattr(self._tok, "encode_batch_fast", self._tok.encode_batch)
        found = batch([self._mark + lead + glue.join(words[i : i + step]) + self._mark for i in range(0, len(words), step)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids[1:], self.dtype) for e in found])
        marks = ids == self._mark_id
        ends = np.flatnonzero(marks) - np.arange(np.count_nonzero(marks))
        if len(ends) != len(words):
            raise ValueError("a word of letters gave a token that stands between words")
        return _column(pa.large_binary(), np.concatenate([[0], ends]) * ids.itemsize, ids[~marks])

    def _learn(self, keys: pa.Array) -> pa.Array:
        """The ids of distinct stems and whole pieces that neither table has."""
        bare = pc.starts_with(keys, "\r") if self.kind == "byte" else pa.array(np.ones(len(keys), bool))
        names = pc.replace_substring_regex(keys, r"^\r", "") if self.kind == "byte" else keys
        plain = self._letters(names)
        parts, order = [], []
        for lead, one in (("", bare), (" ", pc.invert(bare))):
            for letters, two in ((True, plain), (False, pc.invert(plain))):
                at = pc.and_(one, two)
                some = names.filter(at).to_pylist()
                if some:
                    parts.append(self._words(some, lead) if letters else pa.array(self._ids([lead + p for p in some]), pa.large_binary()))
                    order.append(np.flatnonzero(at.to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order)))) if parts else _NONE[1]

    @staticmethod
    def _letters(names: pa.Array) -> pa.Array:
        """Whether names are of letters that stay letters in the tokenizers' normal forms."""
        return pc.and_not(pc.match_substring_regex(names, _LETTERS), pc.match_substring_regex(names, _UNSURE))

    def _known(self, keys: pa.Array) -> pa.Array:
        """The ids of distinct keys, from the tables or learnt for them."""
        held, ids = (pa.concat_arrays(both) for both in zip(self._new, self._old, strict=True))
        at = pc.index_in(keys, value_set=held)
        missing = pc.is_null(at)
        some = keys.filter(missing)
        learnt = self._learn(some)
        place = np.cumsum(missing.to_numpy(zero_copy_only=False)) - 1 + len(held)
        at = pc.if_else(missing, pa.array(place, pa.int64()), at.cast(pa.int64()))
        every = pa.concat_arrays([ids, learnt])
        late = pc.and_(pc.greater_equal(at, len(self._new[0])), pc.invert(missing))
        self._new = pa.concat_arrays([self._new[0], keys.filter(late), some]), pa.concat_arrays([self._new[1], every.take(at.filter(late)), learnt])
        if len(self._new[0]) > self.most_cached // 2:
            self._old, self._new = self._new, _NONE
        return every.take(at)

    def _lookup(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces. A word with trailing marks is its letters, then the marks."""
        byte, n = self.kind == "byte", len(pieces)
        line = pc.starts_with(pieces, "\n") if byte else None
        if byte:
            pieces = pc.replace_substring_regex(pieces, r"^\n", "\r")
        offsets, data = _layout(pieces)
        stems = pc.ascii_rtrim(pieces, _TAIL)
        letters = self._letters(pc.replace_substring_regex(stems, r"^\r", "") if byte else stems)
        length = np.where(letters.to_numpy(zero_copy_only=False), pc.binary_length(stems).to_numpy(), np.diff(offsets))
        halves = np.empty(2 * n + 1, np.int64)
        halves[::2], halves[1::2] = offsets, offsets[:-1] + length
        both = _column(pa.large_string(), halves, data)
        keys, tails = (both.take(pa.array(np.arange(k, 2 * n, 2))) for k in (0, 1))
        if not byte:
            # the tokenizer lower-cases
            keys = pc.if_else(letters, pc.ascii_lower(keys), keys)
        keys, tails = keys.dictionary_encode(), tails.dictionary_encode()
        ends = pa.array(self._ids(tails.dictionary.to_pylist()), pa.large_binary())
        ids = [self._known(keys.dictionary).take(keys.indices), ends.take(tails.indices)]
        if byte:
            ids.insert(0, pc.if_else(line, pa.scalar(self._newline, pa.large_binary()), pa.scalar(b"", pa.large_binary())))
        return _joined(*ids)

    def _pieces(self, texts: pa.LargeStringArray) -> pa.Array:
        """The pieces of each text, as lists."""
        if self.kind == "word":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        run = pc.match_substring_regex(texts, _RUN)
        marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\r", texts, "")))
        plain = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        if not pc.any(run).as_py():
            return plain
        special = []
        for t in texts.filter(run).to_pylist():
            parts = _CUT.split(t)
            special.append(["\r" + parts[0], *parts[1:]])
        place = np.cumsum(run.to_numpy(zero_copy_only=False)) - 1
        which = np.where(run.to_numpy(zero_copy_only=False), place + len(texts), np.arange(len(texts)))
        return pa.concat_arrays([plain, pa.array(special, plain.type)]).take(pa.array(which))
    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype; a null is an empty text."""
        if self.kind == "whole":
            return self._ids([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return []
        lists = self._pieces(pc.fill_null(column.cast(pa.large_string()), ""))
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        words = lists.flatten()
        del lists
        coded = words.dictionary_encode()
        del words
        ids = self._lookup(coded.dictionary)
        out: list[bytes] = []
        # some texts at a time: a word takes 8 bytes besides its ids
        starts = np.unique(np.searchsorted(edges, np.arange(0, edges[-1], 1 << 17), "right") - 1).tolist()
        for i, j in zip(starts, [*starts[1:], len(column)], strict=True):
            offsets, data = _layout(ids.take(coded.indices.slice(edges[i], edges[j] - edges[i])))
            cuts = offsets[edges[i : j + 1] - edges[i]].tolist()
            flat = memoryview(data)
            out += [bytes(flat[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return out


def encoder(path: str, most_cached: int = 1_200_000) -> Encoder:
    """The encoder of a file, one per Python worker."""
    key = (path, most_cached)
    if key not in _encoders:
        _encoders[key] = Encoder(path, most_cached)
    return _encoders[key]


def release() -> None:
    """Gives back what encoders hold in this Python worker, which other operators may use next."""
    if _encoders:
        _encoders.clear()
        trim()


def trim() -> None:
    """Hands memory that is free in this process back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)
