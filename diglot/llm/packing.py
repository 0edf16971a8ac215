"""Packing along a Hilbert curve: neighbouring documents share sequences.

Each document's token ids are hashed with signs into 256 cells, damped by a square root, normalised
and projected to four fixed random directions. The four coordinates, as 12-bit cells of the normal
distribution, give the place on a Hilbert curve. Documents are range-sorted by (place, doc_id) and cut
into sequences of at most `length` ids. Within a range every sequence is full; the rest at its end is
cut into sequences whose sizes are powers of two, so there is no padding.

A null text is an empty text and has the end id only. Rows with the same doc_id are separate
documents. A range of rows is one task, read as a stream, so equal places (copies, empty texts) need no
memory; doc_id splits them between ranges. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.llm.tokens import encoder
from diglot.storage import materialise

CELLS, DIMS, BITS = 256, 4, 12
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, curve long"


def directions() -> np.ndarray:
    """Four fixed directions in the space of cells."""
    flat = np.random.default_rng(20240229).standard_normal((CELLS, DIMS))
    return flat / np.sqrt((flat**2).sum(0))


def coordinates(ids: list[np.ndarray]) -> np.ndarray:
    """The four projections of each document's hashed vector; about standard normal."""
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    h = words.mix(flat + np.uint64(0x5851F42D))
    cell = (h % np.uint64(CELLS)).astype(np.int64) + np.repeat(np.arange(len(ids)), lengths) * CELLS
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    vec = np.bincount(cell, sign, len(ids) * CELLS).reshape(-1, CELLS)
    vec = np.sign(vec) * np.sqrt(np.abs(vec))
    norm = np.sqrt((vec**2).sum(1, keepdims=True))
    return (vec / np.where(norm == 0, 1, norm)) @ directions() * math.sqrt(CELLS)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points [n, dims] with `bits` bits a coordinate (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_places(ids: list[np.ndarray]) -> np.ndarray:
    z = np.clip(coordinates(ids), -8, 8)
    share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2))) if len(ids) else z
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1).reshape(-1, DIMS), BITS)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve (place), width (bytes of an id) and ids of each document, its end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        for batch in batches:
            for rows in words.slices(batch, text_col, 16 << 20):
                ids = [x + end for x in enc.encode(rows.column(text_col))]
                places = [curve_places([np.frombuffer(x, enc.dtype) for x in ids[i : i + 256]]) for i in range(0, len(ids), 256)]
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(np.concatenate(places), pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "curve", "width", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return chosen.mapInArrow(encode, "doc_id long, curve long, width int, ids binary")


class _Packer:
    """Cuts a stream of documents into sequences. Holds the pieces of one sequence."""

    def __init__(self, part: int, length: int):
        self.length, self.next_id = length, part << 40
        self.open: list[list] = []
        self.filled = 0

    def add(self, doc_id: int | None, curve: int, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.filled)
            self.open.append([doc_id, at, ids[at : at + n], len(ids), curve])
            self.filled += n
            at += n
            if self.filled == self.length:
                yield from self._close(self.length)

    def _close(self, size: int) -> Iterator[tuple]:
        """Gives the first `size` ids of the open pieces as one sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, total, curve in self.open:
            here = ids[: size - offset]
            if len(here):
                yield doc_id, start, len(here), zlib.crc32(words.unpack(here)), total, self.next_id, offset, size, curve
                offset += len(here)
            if len(here) < len(ids):
                rest.append([doc_id, start + len(here), ids[len(here) :], total, curve])
        self.open, self.filled = rest, sum(len(x[2]) for x in rest)
        self.next_id += 1

    def end(self) -> Iterator[tuple]:
        while self.filled:
            yield from self._close(1 << (self.filled.bit_length() - 1))


def pack(encoded: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces of all encoded documents, packed along the curve.

    One shuffle, of the encoded ids, by sampled ranges of (place, doc_id). Sequence ids are unique, not
    gapless: 2**40 times the range's number, plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), length)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, curve, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "curve", "width", "ids")), strict=True):
                rows += packer.add(doc_id, curve, np.frombuffer(ids, f"<u{width}"))
                if len(rows) >= 8192:
                    yield table(rows)
                    rows = []
        rows += packer.end()
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    ordered = encoded.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return ordered.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Encodes all documents once, keeps the ids in a table, and packs them along the curve."""
    return pack(materialise(encode_documents(docs, tokenizer, end_id), "encoded"), length)
