"""Token-ID output: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard file is data frames, then two skippable frames:

* the index (magic 0x184D2A50): uint32 width of an id, uint64 documents, then for each document its
  doc_id (int64), its number of ids (uint32) and its frame (uint32);
* the seek table (magic 0x184D2A5E) of the public zstd seekable format: for each frame its compressed
  size, its size and the low 32 bits of the XXH64 of its content (the checksum that ends the frame too);
  at the end the number of frames, a flag byte and the magic 0x8F92EAB1.

Any zstd tool can decompress the whole file; `read_documents` opens only the frames that hold the
documents asked for. Documents are whole within a frame. A null text is an empty text, which has the
end id only; rows with the same doc_id are separate documents in the order of their texts; a null
doc_id comes first and is stored as the least integer. A very long document is one frame, whose sizes fit
their 32 bits: a Spark string is under 2 GB, and has no more ids than bytes. Only the id and text columns are
read, whatever else the table has. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.llm.tokens import encoder
from diglot.storage import fresh_path

INDEX, SEEK, FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
SHARDS = "shard long, path string, first_doc long, n_docs long, n_tokens long, n_frames long, n_bytes long"


class ShardWriter:
    """Writes one shard, frame by frame; holds one frame and 16 bytes a document."""

    def __init__(self, path: str, width: int = 2, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self._fs, self._path = pafs.FileSystem.from_uri(path)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._temp)
        self._zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.width, self._most = width, frame_bytes
        self._docs: list[tuple[int, int, int]] = []
        self._frames: list[tuple[int, int, int]] = []
        self._held: list[bytes] = []
        self._size = self.tokens = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self._docs.append((NO_ID if doc_id is None else doc_id, n, len(self._frames)))
        self._held.append(ids)
        self._size += len(ids)
        self.tokens += n
        if self._size >= self._most:
            self._flush()

    def _flush(self) -> None:
        if not self._held:
            return
        raw = b"".join(self._held)
        frame = self._zip.compress(raw)
        self._out.write(frame)
        self._frames.append((len(frame), len(raw), int.from_bytes(frame[-4:], "little")))
        self._held, self._size = [], 0

    def close(self) -> dict:
        """Ends the file and gives it its name at once, so that a lost attempt leaves no half a shard."""
        self._flush()
        docs = np.array(self._docs, np.dtype("<i8,<u4,<u4")) if self._docs else np.zeros(0, np.dtype("<i8,<u4,<u4"))
        index = struct.pack("<IQ", self.width, len(docs)) + docs.tobytes()
        table = np.array(self._frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self._frames), 0x80, FOOT)
        tail = struct.pack("<II", INDEX, len(index)) + index + struct.pack("<II", SEEK, len(table)) + table
        self._out.write(tail)
        self._out.close()
        self._fs.move(self._temp, self._path)
        return {"path": "", "first_doc": self._docs[0][0] if self._docs else 0, "n_docs": len(docs), "n_tokens": self.tokens, "n_frames": len(self._frames), "n_bytes": sum(f[0] for f in self._frames) + len(tail)}


class ShardReader:
    """Reads documents of one shard, opening a frame only when one of its documents is asked for."""

    def __init__(self, path: str):
        import zstandard

        where, name = pafs.FileSystem.from_uri(path)
        self._in = where.open_input_file(name)
        self._zip = zstandard.ZstdDecompressor()
        end = self._in.size()
        frames, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOT:
            raise ValueError(f"{path}: no seek table")
        begin = end - 9 - 12 * frames - 8
        if struct.unpack("<I", self._at(begin, 4))[0] != SEEK:
            raise ValueError(f"{path}: damaged seek table")
        self.frames = np.frombuffer(self._at(begin + 8, 12 * frames), "<u4").reshape(-1, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        at = int(self.begins[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX or at + 8 + size != begin:
            raise ValueError(f"{path}: damaged index")
        raw = self._at(at + 8, size)
        self.width, n = struct.unpack("<IQ", raw[:12])
        docs = np.frombuffer(raw[12:], np.dtype("<i8,<u4,<u4"), n)
        self.doc_id, self.n_tokens, self.frame = docs["f0"], docs["f1"].astype(np.int64), docs["f2"]
        self.opened = 0

    def _at(self, offset: int, size: int) -> bytes:
        self._in.seek(offset)
        return self._in.read(size)

    def read_frame(self, k: int) -> bytes:
        """Frame k, held against its checksum."""
        import xxhash

        raw = self._zip.decompress(self._at(int(self.begins[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        self.opened += 1
        return raw

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        for k in range(len(self.frames)):
            raw, begin = self.read_frame(k), 0
            while at < len(self.doc_id) and self.frame[at] == k:
                end = begin + int(self.n_tokens[at]) * self.width
                yield int(self.doc_id[at]), np.frombuffer(raw[begin:end], f"<u{self.width}")
                begin, at = end, at + 1

    def documents(self, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
        """The ids of the documents asked for; those not in the shard are left out."""
        wanted = np.flatnonzero(np.isin(self.doc_id, doc_ids))
        out: dict[int, list[np.ndarray]] = {}
        for k in np.unique(self.frame[wanted]):
            raw = self.read_frame(int(k))
            inside = np.flatnonzero(self.frame == k)
            ends = np.cumsum(self.n_tokens[inside]) * self.width
            for j, end in zip(inside, ends, strict=True):
                if j in wanted:
                    out.setdefault(int(self.doc_id[j]), []).append(np.frombuffer(raw[int(end - self.n_tokens[j] * self.width) : int(end)], f"<u{self.width}"))
        return out


def write_shards(docs: DataFrame, where: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = 1 << 18) -> DataFrame:
    """Encodes all documents in ascending id order and writes a shard for each range of ids; returns the table of shards.

    The only shuffle is the range sort of the texts. Its ranges are sampled, so no id range is large
    unless one id is; such a shard is still written as a stream.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        width = np.dtype(enc.dtype).itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        shard, path = None, f"{where}/shard-{part:07d}.zst"
        for batch in batches:
            for rows in words.slices(batch, text_col, 16 << 20):
                shard = shard or ShardWriter(path, width, frame_bytes)
                for i, ids in zip(rows.column(id_col).to_pylist(), enc.encode(rows.column(text_col)), strict=True):
                    shard.add(i, ids + end)
        if shard:
            row = shard.close() | {"path": path, "shard": part}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("path", pa.string())] + [(k, pa.int64()) for k in ("first_doc", "n_docs", "n_tokens", "n_frames", "n_bytes")]))

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    shards = ordered.mapInArrow(write, SHARDS)
    shards.write.parquet(f"{where}/shards")
    return docs.sparkSession.read.schema(SHARDS).parquet(f"{where}/shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    The running total needs one row per shard in one task, about 100 bytes for each shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["base"], []
                for doc_id, ids in ShardReader(row["path"]):
                    rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(words.unpack(ids)), row["shard"]))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _table(rows)
                        rows = []
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = max(1, min(shards.count(), 2 * shards.sparkSession.sparkContext.defaultParallelism))
    return based.repartition(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to shards in the shared folder and reads all of them back."""
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "token-files"), tokenizer, end_id))
