"""Words of Arrow text columns, found and hashed on the UTF-8 bytes without a Python string per word.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r. A null text has no words. Hashes are 64
bits wide and the same in every process; the operators treat equal hashes as equal words (at 10^7
distinct words the chance of any collision is about 3 in a million).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have, dtype=_U)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair (a, b)."""
    with np.errstate(over="ignore"):
        return mix(a * _U(0xD6E8FEB86659FD93) + mix(b + _U(0x9E3779B97F4A7C15)))


class Words(NamedTuple):
    """Words of some rows: their hashes, row numbers, byte ranges in data; and words per row."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.count)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(column: pa.Array, lower: bool = False) -> Words:
    """The words of each row, with A-Z lower-cased first if asked."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), zero, zero, zero, np.zeros(len(offsets) - 1, np.int64), data, offsets)
    inside = IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    count = np.diff(np.searchsorted(first, offsets))
    row = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _power(_ODD, n), out=total[1:])
        value = (total[last] - total[first]) * _power(_INVERSE, n)[first]
        value = mix(value + (last - first).astype(_U) * _U(0xA24BAED4963EE407))
    return Words(value, row, first, last, count, data, offsets)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows whose texts take about most_bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size + 64) // most_bytes
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [n]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(a, b - a)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of size words; a row with fewer words, but one at least, has one window."""
    bounds = words.bounds()
    count, n = words.count, len(words.hash)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(words.hash * _power(_ODD, n), out=total[1:])
        many = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
        row = np.repeat(np.arange(len(count)), many)
        start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + bounds[:-1][row]
        end = np.minimum(start + size, bounds[1:][row])
        return mix((total[end] - total[start]) * _power(_INVERSE, n)[start] + (end - start).astype(_U)), row


def unpack(values: np.ndarray, dtype: str = "<u4") -> bytes:
    return np.ascontiguousarray(values, dtype).tobytes()


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of data, wherever they lie."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _power(_ODD, n), out=total[1:])
        return mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def span_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of a sequence of 64-bit values."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(mix(values + _U(0x51_7C_C1_B7)) * _power(_ODD, n), out=total[1:])
        return mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))
