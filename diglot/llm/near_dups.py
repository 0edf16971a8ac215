"""MinHash near-dedup by BagMinHash signatures of five-word shingles.

A document is a bag: each shingle with its count. Every (shingle, level) pair has its own Poisson
process, where the levels are the intervals (0,1], (1,2], (2,4], (4,8] ... of the weight axis: the
discretisation is exact for counts. A process yields points in time order; each point has a signature
slot and a place in its interval, and counts for a bag if the place is within the count. A slot's value
is the first time that hits it. Two bags agree in a slot with the probability of their weighted Jaccard
similarity, without bias. A process is left as soon as its time exceeds the largest slot of the
document, so most of them end after a point or two.

The signatures are banded; documents that share a band are candidates; candidates are verified by
the exact overlap of their bags (sum of minima over sum of maxima). Texts with the same words are first
reduced to one representative. Within a band all members are held against its least one. If members are then in
different components, those of a band of up to GROUP members are held against each other. The members of larger
bands are joined by prefixes, which is exact: with all shingles in one order, the rarest first, two
bags of the similarity share one of their first ones, and the first that they share leaves enough behind it in
both. The shingles of a prefix are mostly a document's own, so few pairs are verified; those of one shingle are
first held against its least document too. No link between documents that share a band is left out.

Defined cases: words are cut at ASCII white space, A-Z lower-cased; a text with one to four words is
one shingle; a text without words (null, empty) is in a class of its own and never a copy; repeated
rows with one doc_id are one document, also where their texts differ: each of its texts is banded, it is
linked by any of them, and it stays or goes with all its rows; a very long text is one bag
like any other; other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.llm.components import components
from diglot.llm.member_filter import maybe_in
from diglot.storage import materialise

SHINGLE, BANDS, DEPTH, GROUP, CELLS = 5, 25, 5, 128, 1 << 20
_U = np.uint64


def bags(w: words.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags of all rows, ordered by row: row, shingle (48 bits) and count."""
    h, row = words.windows(w, size)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    if len(w.count) > 1 << 16:
        raise ValueError("at most 65536 rows at once")
    key = np.sort((row.astype(_U) << _U(48)) | (h >> _U(16)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, len(key)))
    return (key[at] >> _U(48)).astype(np.int64), key[at] & _U((1 << 48) - 1), count


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """BagMinHash signatures [rows, slots]; a row without shingles keeps infinity."""
    sig = np.full(rows * slots, np.inf)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    at = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low).astype(np.int64)
    doc, weight = row[at], count[at]
    seed = words.mix(shingle[at] * _U(0x9E3779B97F4A7C15) + level.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(1))
    time = np.zeros(len(at))
    step = 0
    with np.errstate(over="ignore"):
        while len(doc):
            step += 1
            a = words.mix(seed + _U(step) * _U(0x9E3779B97F4A7C15))
            b = words.mix(a ^ _U(0x5851F42D4C957F2D))
            unit = ((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(unit) / (width * slots)
            slot = (b % _U(slots)).astype(np.int64)
            hit = low + ((b >> _U(20)) % width.astype(_U)).astype(np.int64) < weight
            np.minimum.at(sig, doc[hit] * slots + slot[hit], time[hit])
            worst = sig.reshape(rows, slots).max(1)
            alive = time < worst[doc]
            doc, weight, seed, time, low, width = doc[alive], weight[alive], seed[alive], time[alive], low[alive], width[alive]
    return sig.reshape(rows, slots)


def band_keys(sig: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """A hash of each band of each signature [rows, bands]."""
    bits = np.ascontiguousarray(sig[:, : bands * depth]).view(_U).reshape(len(sig), bands, depth)
    # the band's number is part of the hash
    key = np.full((len(sig), bands), _U(0x1234567)) + np.arange(bands, dtype=_U)
    for k in range(depth):
        key = words.pair(key, bits[:, :, k])
    return key


def sketch(docs: DataFrame, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """doc_id, exact (a hash of the words, null without words), n_shingles and the band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 19):
                for i in range(0, part.num_rows, 1 << 15):
                    rows = part.slice(i, 1 << 15)
                    w = words.split(rows.column("text"), lower=True)
                    bounds = w.bounds()
                    whole = words.span_of(w.hash, bounds[:-1], bounds[1:])
                    row, shingle, count = bags(w)
                    keys = band_keys(signatures(row, shingle, count, rows.num_rows, bands * depth), bands, depth)
                    none = w.count == 0
                    total = np.bincount(row, count, rows.num_rows).astype(np.int64)
                    flat = pa.array(keys[~none].astype(_U).view(np.int64).ravel())
                    offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(whole.view(np.int64), mask=none), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "exact", "n_shingles", "bands"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id IS NOT NULL")
    return chosen.mapInArrow(run, "doc_id long, exact long, n_shingles long, bands array<long>")


def overlaps(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose bags overlap by `least` or more, and the overlap.

    Texts pass a filter of fixed size before they move, so only those of paired documents do. The links of one document with very many are spread by a salt,
    and its text is sent to each salt in use.
    """
    some = maybe_in(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), "a")
    texts = texts.where(some(F.col("doc_id")))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    left = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text_b", 1 << 18):
                for part in words.slices(some, "text_a", 1 << 18):
                    value = overlap(part.column("text_a"), part.column("text_b"))
                    found = value >= least
                    yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(found)), part.column("b").filter(pa.array(found)), pa.array(value[found])], names=["a", "b", "overlap"])

    return right.join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, overlap double")


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of the bags of two columns, row by row; 0 for texts without words."""
    n = len(left)
    out = np.zeros(n)
    for i in range(0, n, 1 << 15):
        a, b = (bags(words.split(x.slice(i, 1 << 15), lower=True)) for x in (left, right))
        size = min(n - i, 1 << 15)
        key = np.concatenate([(r.astype(_U) << _U(48)) | s for r, s, _ in (a, b)])
        order = np.argsort(key, kind="stable")
        count = np.concatenate([a[2], b[2]])[order]
        key = key[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        common = np.bincount((key[same] >> _U(48)).astype(np.int64), np.minimum(count[same], count[same + 1]), size)
        total = np.bincount(a[0], a[2], size) + np.bincount(b[0], b[2], size)
        out[i : i + size] = np.where(total > 0, common / np.maximum(total - common, 1), 0)
    return out


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bags as sets: row and element, a hash of a shingle and which of its occurrences it is."""
    row, shingle, count = bags(words.split(column, lower=True))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(row, count), words.pair(np.repeat(shingle, count), nth.astype(_U))


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """doc_id, root, n (size of the bag), element and at (its place) for the first elements of each text, the rarest first.

    How rare an element is is told by a table of fixed size, in which elements may share a cell: any order that
    is the same for all texts is exact.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 20):
                for i in range(0, part.num_rows, 1 << 15):
                    yield part.slice(i, 1 << 15)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in parts(batches):
            total += np.bincount((elements(part.column("text"))[1] % _U(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(CELLS, np.int64)
    rarity[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(np.minimum(rarity, (1 << 32) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            row, element = elements(part.column("text"))
            rare = sent.value[element % _U(CELLS)]
            order = np.lexsort((element, rare, row))
            row, element, rare = row[order], element[order], rare[order]
            n = np.bincount(row, minlength=part.num_rows)
            at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            # an element alone in its cell has no like
            first = (at <= n[row] - np.ceil(least * n[row] - 1e-6)) & (rare > 1)
            row, element, at = row[first], element[first], at[first]
            doc, root = (part.column(c).take(pa.array(row)) for c in ("doc_id", "root"))
            yield pa.RecordBatch.from_arrays([doc, root, pa.array(n[row]), pa.array(element.view(np.int64)), pa.array(at)], names=["doc_id", "root", "n", "element", "at"])

    return texts.select("doc_id", "root", "text").mapInArrow(run, "doc_id long, root long, n long, element long, at long")


def links(docs: DataFrame, sketches: DataFrame, least: float = 0.8, most_pairs: int = GROUP) -> DataFrame:
    """Verified links a < b between representatives, which have the components of all links that share a band. The members of bands of more than most_pairs are joined by their prefixes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    bounded = sketches.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    hubs = bounded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialise(bounded.join(hubs.select("key", "hub"), "key"), "members")
    # a document of several texts has several sizes
    size = member.groupBy("doc_id").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose sizes alone rule out the similarity are left out before their texts are read."""
        a, b = (size.select(F.col("doc_id").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ab")
        near = pairs.distinct().join(a, "a").join(b, "b").where((F.col("high_a") >= least * F.col("low_b")) & (F.col("high_b") >= least * F.col("low_a")))
        return materialise(overlaps(materialise(near.select("a", "b"), "pairs"), texts, least).select("a", "b"), "links")

    found = verified(member.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), texts)
    root = components(found).withColumnRenamed("node", "doc_id")
    placed = member.select("key", "doc_id").join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("key", "n")
    left_over = materialise(placed.join(open_, "key").select("key", "doc_id", "root", "n"), "open")
    small = left_over.where(F.col("n") <= most_pairs)
    a, b = small.alias("a"), small.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")))
    found = found.unionByName(verified(cross.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")), texts))
    large = left_over.where(F.col("n") > most_pairs).select("doc_id", "root").distinct()
    if large.isEmpty():
        return found
    some = maybe_in(large, "doc_id")
    own = materialise(texts.where(some(F.col("doc_id"))).join(large, "doc_id"), "texts")
    # sizes that allow the similarity are in one class or in two that follow each other
    step = -math.log(min(least, 0.999)) * (1 + 1e-9)
    first = materialise(prefixes(own, least).withColumn("class", F.floor(F.log("n") / step).cast("int")), "prefixes")

    def enough(a: str, b: str) -> Column:
        """Whether the elements from the shared one on allow the similarity."""
        common = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (least / (1 + least)) - 1e-6
        return F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")) >= common

    heads = first.groupBy("element", "class").agg(F.min(F.struct("doc_id", "root", "n", "at")).alias("hub"))
    near = first.alias("b").join(heads, ["element", "class"]).where((F.col("root") != F.col("hub.root")) & enough("hub", "b"))
    found_first = verified(near.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")), own)
    # the roots so far, and the new links between them
    star = large.select(F.col("root").alias("a"), F.col("doc_id").alias("b"))
    root = components(found_first.unionByName(star)).withColumnRenamed("node", "doc_id")
    first = materialise(first.drop("root").join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "prefixes")
    first = first.withColumn("same", F.col("class"))
    a, b = first.alias("a"), first.withColumn("class", F.explode(F.array("class", F.col("class") - 1))).alias("b")
    pair = (F.col("a.element") == F.col("b.element")) & (F.col("a.class") == F.col("b.class"))
    pair &= F.when(F.col("a.same") == F.col("b.same"), F.col("a.root") < F.col("b.root")).otherwise(F.col("a.root") != F.col("b.root"))
    cross = a.join(b, pair & enough("a", "b")).select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))
    return found.unionByName(found_first).unionByName(verified(cross, own))


def classes(docs: DataFrame, least: float = 0.8, most_pairs: int = GROUP) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size and kept (the one that stays) for every document."""
    # equal texts have equal sketches
    sketches = materialise(sketch(docs).groupBy("doc_id", "exact").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "sketches")
    same = sketches.groupBy("exact").agg(F.min("doc_id").alias("rep")).where("exact IS NOT NULL")
    member = materialise(sketches.select("doc_id", "exact").join(same, "exact", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "exact")
    own = sketches.join(same.select("exact", F.col("rep").alias("doc_id")), ["exact", "doc_id"], "left_semi")
    # the representatives of a document's texts are linked by it
    least_rep = member.groupBy("doc_id").agg(F.min("rep").alias("a"))
    several = member.join(least_rep, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    root = components(links(docs, own, least, most_pairs).unionByName(several))
    named = least_rep.withColumnRenamed("a", "rep").join(root.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    counted = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return named.join(counted, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs that aren't copies of another document, with the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("copy_id" + "_" * i for i in range(99)) if n not in taken)
    gone = materialise(classes(docs, least).where(~F.col("kept")).select(F.col("doc_id").alias(name)), "copies")
    # rows that surely stay aren't shuffled
    some = maybe_in(gone, name)(F.col("doc_id"))
    return docs.where(~some).unionByName(docs.where(some).join(gone, docs["doc_id"] == gone[name], "left_anti"))
