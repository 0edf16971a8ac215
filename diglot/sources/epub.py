"""Books as tables of archive members: a reader and a writer for `format("epub")`.

Reading gives a row for each member (book, path, ord, stored, content); each book is a partition. Later
members with a name that came before shadow it when `latest` is true (the default), as zip readers do.
Writing takes the same rows (stored is not used): each task writes the books of its rows, so rows must be
partitioned by book. `save` does that. A book gets its name when the job commits.
"""

from __future__ import annotations

import os
import struct
import tempfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from diglot.functions import paths
from diglot.functions.decode import decoded
from diglot.shipping import ship

MEMBERS = "book string, path string, ord int, stored boolean, content binary"


#: Bytes of members that go to Spark at once.
AT_ONCE = 1 << 20


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in MEMBERS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class Archive(zipfile.ZipFile):
    """An archive whose directory is read entry by entry: kept, the entries of a million members take a GB."""

    def _RealGetContents(self) -> None:
        try:
            end = zipfile._EndRecData(self.fp)
        except OSError:
            end = None
        if not end:
            raise zipfile.BadZipFile("File is not a zip file")
        self._comment, self.size = end[zipfile._ECD_COMMENT], end[zipfile._ECD_SIZE]
        self.before = end[zipfile._ECD_LOCATION] - self.size - end[zipfile._ECD_OFFSET]  # bytes that stand before the archive
        if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
            self.before -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
        self.start_dir = end[zipfile._ECD_OFFSET] + self.before
        if self.start_dir < 0:
            raise zipfile.BadZipFile("Bad offset for central directory")

    def directory(self) -> Iterator[zipfile.ZipInfo]:
        with open(self.filename, "rb", 1 << 16) as f:
            f.seek(self.start_dir)
            while f.tell() < self.start_dir + self.size:
                head = f.read(zipfile.sizeCentralDir)
                if len(head) != zipfile.sizeCentralDir or not head.startswith(zipfile.stringCentralDir):
                    raise zipfile.BadZipFile("Bad magic number for central directory")
                _, made, system, needs, reserved, flags, method, time_, date, crc, packed, size, names, extras, comments, _, inner, outer, at = struct.unpack(zipfile.structCentralDir, head)
                raw = f.read(names)
                x = zipfile.ZipInfo(raw.decode("utf-8" if flags & 0x800 else "cp437"))
                x.extra, x.comment = f.read(extras), f.read(comments)
                x.create_version, x.create_system, x.extract_version, x.reserved, x.flag_bits, x.compress_type, x._raw_time = made, system, needs, reserved, flags, method, time_
                x.date_time = (date >> 9) + 1980, date >> 5 & 15, date & 31, time_ >> 11, time_ >> 5 & 63, (time_ & 31) * 2
                x.CRC, x.compress_size, x.file_size, x.internal_attr, x.external_attr, x.header_offset = crc, packed, size, inner, outer, at
                x._decodeExtra(zlib.crc32(raw))
                x.header_offset += self.before
                yield x

    def last_of_repeated(self) -> dict[str, int]:
        """Where the names that come more than once, by their hashes, come last."""
        hashes = np.fromiter((hash(x.filename) for x in self.directory()), np.int64)
        some, n = np.unique(hashes, return_counts=True)
        if not (again := set(some[n > 1].tolist())):
            return {}
        return {x.filename: k for k, x in enumerate(self.directory()) if hash(x.filename) in again}


class NewArchive:
    """Writes an archive of whole members; its directory waits in a file of its own."""

    def __init__(self, path: str):
        self.out, self.entries, self.n, self.at = open(path, "wb"), tempfile.TemporaryFile(), 0, 0  # noqa: SIM115
        y, mo, d, h, mi, s = time.localtime()[:6]
        self.when = h << 11 | mi << 5 | s // 2, (y - 1980) << 9 | mo << 5 | d

    def _put(self, *parts: bytes) -> None:
        for x in parts:
            self.out.write(x)
            self.at += len(x)

    def add(self, path: str, content: bytes, stored: bool) -> None:
        path = path.partition("\0")[0]
        name, squeeze = path.encode(), zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        body = content if stored else squeeze.compress(content) + squeeze.flush()
        same = 0 if path.isascii() else 0x800, 0 if stored else 8, *self.when, zlib.crc32(content), len(body), len(content), len(name)
        far = struct.pack("<HHQ", 1, 8, self.at) if self.at >= 0xFFFFFFFF else b""
        entry = struct.pack("<4s6H3I5H2I", b"PK\1\2", 3 << 8 | 45, 45 if far else 20, *same, len(far), 0, 0, 0, 0o600 << 16, min(self.at, 0xFFFFFFFF))
        self.entries.write(entry + name + far)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 20, *same, 0), name, body)
        self.n += 1

    def close(self) -> None:
        start, n = self.at, self.n
        self.entries.seek(0)
        while part := self.entries.read(1 << 20):
            self._put(part)
        self.entries.close()
        size, end = self.at - start, self.at
        if n >= 0xFFFF or max(start, size) >= 0xFFFFFFFF:
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start), struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
        self.out.close()


@dataclass
class Book(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    books: list[tuple[str, str]]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.html_only = str(options.get("html", "false")).lower() == "true"
        self.latest = str(options.get("latest", "true")).lower() == "true"

    def partitions(self) -> list[Book]:
        found = sorted(glob(os.path.join(self.where, "*.epub"))) if os.path.isdir(self.where) else sorted(glob(self.where))
        return [Book(p) for p in found]

    def read(self, partition: Book) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(partition.path).removesuffix(".epub")
        rows, size = [], 0
        with Archive(partition.path) as z:
            last = z.last_of_repeated() if self.latest else {}
            for k, x in enumerate(z.directory()):
                if x.is_dir() or last.get(x.filename, k) != k or (self.html_only and not x.filename.lower().endswith((".html", ".htm", ".xhtml"))):
                    continue
                rows.append((name, x.filename, k, x.compress_type == zipfile.ZIP_STORED, z.read(x)))
                size += 100 + len(rows[-1][4])
                if size >= AT_ONCE:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.where = options["path"]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.where, exist_ok=True)
        books: list[tuple[str, str]] = []
        out = name = None
        for r in rows:
            if r.book != name:
                if out:
                    out.close()
                name = r.book
                temp = os.path.join(self.where, f".{name}.{uuid.uuid4().hex}.tmp")
                books.append((temp, os.path.join(self.where, f"{name}.epub")))
                out = NewArchive(temp)
            out.add(r.path, bytes(r.content), r.path == "mimetype")
        if out:
            out.close()
        return Written(books)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temp, final in m.books if m else []:
                os.replace(temp, final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temp, _ in m.books if m else []:
                if os.path.exists(temp):
                    os.remove(temp)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members of a book, or of all books in a folder."""
    ship(spark)
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").options(**options).load(path)


def save(table: DataFrame, folder: str) -> None:
    """Writes a book for each `book` of a table of members: mimetype first and stored, then paths in order."""
    ship(table.sparkSession)
    table.sparkSession.dataSource.register(EpubSource)
    first = F.col("path") != "mimetype"
    ordered = table.select("book", "path", F.lit(0).alias("ord"), F.lit(False).alias("stored"), "content").repartition("book").sortWithinPartitions("book", first, "path")
    ordered.write.format("epub").mode("append").save(folder)


def texts(table: DataFrame) -> DataFrame:
    """members with text, bad and warn (see functions.decode)."""
    return table.withColumn("d", decoded("content")).select(*table.columns, "d.text", "d.bad", "d.warn")


def spliced(table: DataFrame, updates: DataFrame) -> DataFrame:
    """members with updates (book, path, content) put in place or added: the checkpoint of a book."""
    new = updates.select("book", "path", F.col("content").alias("new"))
    both = table.select("book", "path", "ord", "content").join(new, ["book", "path"], "full")
    return both.select("book", "path", F.coalesce("ord", F.lit(1 << 30)).alias("ord"), F.coalesce("new", "content").alias("content"))


def appended(table: DataFrame) -> DataFrame:
    """The latest content of each path of a log of members (book, path, seq, content)."""
    return table.groupBy("book", "path").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def unsafe_names(table: DataFrame) -> DataFrame:
    """book, path, why: names that file systems refuse, or that differ from others in case only."""
    refused = table.where(F.col("path").rlike(r'[:*?"<>|]')).select("book", "path", F.lit("characters").alias("why"))
    per = Window.partitionBy("book", F.lower("path"))
    cases = table.select("book", "path").distinct().withColumn("n", F.count(F.lit(1)).over(per)).where("n > 1").select("book", "path", F.lit("case").alias("why"))
    return refused.unionByName(cases)


def short_names(table: DataFrame) -> DataFrame:
    """book, name: the HTML files whose names say that their blocks are short."""
    return table.where(paths.is_html("path") & paths.is_short("path")).select("book", paths.basename("path").alias("name")).distinct()


def target_name(book):
    """The name of a target-only book from that of a bilingual one."""
    from diglot.functions.text import safe_name

    bare = F.regexp_replace(book, "(_zh)?[-_]bilingual|-中英双语", "")
    return F.concat(safe_name(bare), F.lit("-中文"))


def fingerprints(table: DataFrame) -> DataFrame:
    return table.withColumn("sha1", F.sha1("content"))


def html_members(table: DataFrame) -> DataFrame:
    return table.where(paths.is_html("path"))
