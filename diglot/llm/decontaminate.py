"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

A document matches an item of n words if some run of its words is within floor(n / 5) word edits
(insertions, deletions, substitutions) of the whole item: a similarity of 0.8. For each item length
every window of the document's words, one at each word, is a candidate place. Three steps decide:

1. A lossless filter: an item with at most k edits keeps one of k + 1 disjoint pieces unchanged. A piece
   found in the text allows 2k + 1 places for the match's first word, and only these windows go on.
2. These windows are embedded by CGK random walks (position j of the output repeats the word under a
   pointer that a random bit of (walk, j, word) moves on), which turns few edits into a small Hamming
   distance. Samples of a few positions, repeated over walks and tables, are looked up among the
   items' samples. Each item length has its own number of tables, from simulated edits of random texts of
   that length at the full edit bound (`tables_for`), so that every length reaches the target recall, whatever
   else is searched for. Lengths that no number of tables serves go from the filter to the third step.
3. The candidates are verified by the exact edit distance, many at once.

Items with the same words are one entry of the index. The items are held in every task: their size is
checked first, and more items than `most_bytes` are taken in several passes over the documents, with the
same result. Nothing of the documents is shuffled.

Defined cases: words are cut at ASCII white space, A-Z lower-cased; null or empty texts and items match
nothing; items of fewer than five words match without edits only; repeated items give a row each;
repeated documents are searched one by one; a very long text is searched whole, in windows of a bounded number
at once; of several places with as few edits the first counts; other columns, whatever their names, pass
through `remove` and aren't read by `search`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diglot.llm import words

WALKS, SAMPLED = 24, 3
_U = np.uint64
_END = np.uint64(0xFFFFFFFFFFFFFFF1)
MATCHES = "doc_id long, item_id long, edits int, item_words int, start_word long, end_word long"


_SALT = words.mix(np.arange(WALKS, dtype=_U) + _U(0x1DEA))[:, None]
_samples: dict[tuple[int, int], np.ndarray] = {}


def sampled_places(length: int, tables: int) -> np.ndarray:
    """The sampled output positions [WALKS, tables, SAMPLED] for windows of a length, the same everywhere."""
    if (length, tables) not in _samples:
        rng = np.random.default_rng(length * 7919)
        most = max(2 * length, SAMPLED)
        _samples[length, tables] = np.sort(rng.random((WALKS, tables, most)).argsort(2)[:, :, :SAMPLED], axis=2)
    return _samples[length, tables]


def embed(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, tables: int) -> np.ndarray:
    """Table keys [n, WALKS * tables] of the CGK embeddings of the windows [start, end), for items of `lengths` words."""
    out = np.empty((len(starts), WALKS * tables), _U)
    padded = np.append(hashes, _END)
    step = max(1, (1 << 19) // (WALKS * 2 * max(1, int(lengths.max(initial=1)))))
    with np.errstate(over="ignore"):
        for a in range(0, len(starts), step):
            end, length = ends[a : a + step], lengths[a : a + step]
            kinds, which = np.unique(length, return_inverse=True)
            places = np.stack([sampled_places(int(n), tables) for n in kinds])
            at = np.tile(starts[a : a + step], (WALKS, 1))
            most = int(places.max()) + 1
            seen = np.empty((most, WALKS, len(end)), _U)
            for j in range(most):
                word = padded[np.where(at < end, at, len(hashes))]
                seen[j] = word
                at += ((words.mix(word + _SALT + _U(j * 0x2545F491)) >> _U(37)) & _U(1)).astype(np.int64)
            mine = places[which]
            walk = np.arange(WALKS)[None, :, None]
            row = np.arange(len(end))[:, None, None]
            key = words.mix(length.astype(_U))[:, None, None] + (np.arange(WALKS * tables, dtype=_U).reshape(1, WALKS, tables) << _U(20))
            for k in range(SAMPLED):
                key = words.pair(key, seen[mine[:, :, :, k], walk, row])
            out[a : a + step] = key.reshape(len(end), -1)
    return out


def edit_distances(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of items [m, n] the least edits to a prefix of its text [m, t], and that prefix's length.

    Texts are padded with _END, which no item has; rows beyond `most` edits have most + 1 and 0.
    """
    m, t = texts.shape
    span = np.arange(t + 1)
    row = np.tile(span, (m, 1))
    live = np.arange(m)
    edits, used = np.full(m, most + 1), np.zeros(m, np.int64)
    for i in range(items.shape[1]):
        new = np.empty((len(live), t + 1), np.int64)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts[live] != items[live, i, None]))
        new = np.minimum.accumulate(new - span, axis=1) + span
        good = new.min(1) <= most
        live, row = live[good], new[good]
        if not len(live):
            return edits, used
    # words after the text's end are no part of a match
    row = np.where(np.cumsum(np.pad(texts[live], ((0, 0), (1, 0))) == _END, axis=1) > 0, most + 1, row)
    end = row.argmin(1)
    edits[live], used[live] = row[np.arange(len(live)), end], end
    edits[live[edits[live] > most]] = most + 1
    return edits, used


def bound(n: int) -> int:
    return n // 5


def pieces(n: int) -> list:
    """bound(n) + 1 disjoint ranges that cover n words."""
    cuts = np.linspace(0, n, bound(n) + 2).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class Index:
    """The items' pieces and table keys. Items with the same words are one entry."""

    def __init__(self, item_ids: list[int], texts: list[str | None], tables: dict[int, int]):
        w = words.split(pa.array(texts, pa.string()), lower=True)
        edges = w.bounds()
        same: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        self.ids: list[list[int]] = []
        for k, i in enumerate(item_ids):
            h = w.hash[edges[k] : edges[k + 1]]
            if len(h):
                at = same.setdefault(h.tobytes(), len(self.items))
                if at == len(self.items):
                    self.items.append(h)
                    self.ids.append([])
                self.ids[at].append(i)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for h in self.items:
            for a, b in pieces(len(h)):
                found.setdefault(b - a, []).append((int(words.span_of(h, np.array([a]), np.array([b]))[0]), len(h), a))
        self.pieces = {}
        for size, rows in found.items():
            rows = sorted(set(rows))
            key = np.array([r[0] for r in rows], _U)
            screen = np.zeros(1 << 18, bool)
            screen[(key & _U((1 << 18) - 1)).astype(np.int64)] = True
            self.pieces[size] = key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), screen
        lengths = np.array([len(h) for h in self.items], np.int64)
        self.tables_of = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
        for n in np.unique(lengths):
            self.tables_of[n] = tables[int(n)]
        #: tables -> sorted keys and the item of each; 0 tables: lengths in ascending order and the item of each
        self.by_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in sorted({int(x) for x in self.tables_of[lengths]}):
            mine = np.flatnonzero(self.tables_of[lengths] == t)
            if not t:
                order = np.argsort(lengths[mine], kind="stable")
                self.by_tables[t] = lengths[mine][order], mine[order]
                continue
            flat, size = np.concatenate([self.items[k] for k in mine]), lengths[mine]
            ends = np.cumsum(size)
            key = embed(flat, ends - size, ends, size, t)
            order = np.argsort(key.ravel(), kind="stable")
            self.by_tables[t] = key.ravel()[order], mine[order // key.shape[1]]

    def starts(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of the windows that hold a piece of an item of that length where it may be."""
        bounds = w.bounds()
        out = []
        n = len(w.hash)
        for size, (key, length, offset, screen) in self.pieces.items():
            if n < size:
                continue
            begin = np.arange(n - size + 1)
            value = words.span_of(w.hash, begin, begin + size)
            maybe = np.flatnonzero(screen[(value & _U((1 << 18) - 1)).astype(np.int64)] & (w.row[begin] == w.row[begin + size - 1]))
            low, high = np.searchsorted(key, value[maybe]), np.searchsorted(key, value[maybe], side="right")
            many = high - low
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(maybe, many)
            for k in np.unique(length[at] // 5):
                mine = length[at] // 5 == k
                shift = np.arange(-k, k + 1)
                start = (place[mine] - offset[at[mine]])[:, None] + shift
                row = w.row[place[mine]]
                good = (start >= bounds[row][:, None]) & (start <= place[mine][:, None])
                out.append(np.stack([start, np.broadcast_to(length[at[mine]][:, None], start.shape)], 2)[good])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.concatenate(out)
        code = np.unique(both[:, 0] * (1 << 24) + both[:, 1])
        return code >> 24, code & ((1 << 24) - 1)

    def candidates(self, w: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First word and item of windows and items that share a table key, some at a time."""
        if not self.items or not len(w.hash):
            return
        start, length = self.starts(w)
        end = np.minimum(start + length, w.bounds()[1:][w.row[start]])
        for t, (key, which) in self.by_tables.items():
            mine = np.flatnonzero(self.tables_of[length] == t)
            for a in range(0, len(mine), 1 << 13):
                some = mine[a : a + (1 << 13)]
                asked = embed(w.hash, start[some], end[some], length[some], t) if t else length[some, None]
                low, high = np.searchsorted(key, asked.ravel()), np.searchsorted(key, asked.ravel(), side="right")
                window = np.repeat(start[some], asked.shape[1])
                for part in bounded(high - low):
                    many = high[part] - low[part]
                    item = which[np.repeat(low[part], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    pairs = np.unique(np.stack([np.repeat(window[part], many), item], 1), axis=0)
                    yield pairs[:, 0], pairs[:, 1]

    def matches(self, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(row, item's place) -> edits, words of the item, first word and end in the row's text; the best place for each pair."""
        w = words.split(column, lower=True)
        bounds = w.bounds()
        text = np.append(w.hash, _END)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for start, item in self.candidates(w):
            size = np.array([len(self.items[k]) for k in item], np.int64)
            for n in np.unique(size):
                most = bound(int(n))
                of = np.flatnonzero(size == n)
                step = max(1, (1 << 19) // (int(n) + most))
                for a in range(0, len(of), step):
                    s, k = start[of[a : a + step]], item[of[a : a + step]]
                    row = w.row[s]
                    place = s[:, None] + np.arange(n + most)
                    runs = text[np.where(place < bounds[row + 1][:, None], place, len(w.hash))]
                    edits, used = edit_distances(np.stack([self.items[x] for x in k]), runs, most)
                    for j in np.flatnonzero(edits <= most):
                        pair, first = (int(row[j]), int(k[j])), int(s[j] - bounds[row[j]])
                        have = best.get(pair)
                        if not have or (edits[j], first) < (have[0], have[2]):
                            best[pair] = int(edits[j]), int(n), first, first + int(used[j])
        return best


def bounded(many: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices with a sum of at most `most`, or of one element."""
    part = np.cumsum(many) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(many)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def planned(texts: list[str | None], recall: float) -> dict[int, int]:
    """The tables of each length that the items have."""
    return {int(n): tables_for(int(n), recall) for n in np.unique(words.split(pa.array(texts, pa.string())).count)}


TABLES = (1, 2, 4, 8, 16, 32)


@lru_cache(maxsize=None)
def tables_for(n: int, recall: float, trials: int = 600) -> int:
    """The tables a walk needs so that items of n words at the full edit bound share a key with the target probability.

    0 if TABLES aren't enough, or the item is so long that planning would take minutes.

    It depends on the length and the target only. Lengths are planned by the next one up of about eight to a doubling:
    longer items need no fewer tables.
    """
    if n < 5:
        return 1
    if n > 512:
        return 0
    grid = 5
    while grid < n:
        grid = max(grid + 1, round(grid * 2 ** (1 / 8)))
    if grid != n:
        return tables_for(grid, recall, trials)
    rng = np.random.default_rng(11 + n)
    flat, sizes = [], []
    for _ in range(trials):
        item = rng.integers(1 << 62, size=n).astype(_U)
        text = item.tolist()
        for _ in range(bound(n)):
            at, kind = int(rng.integers(len(text))), rng.integers(3)
            if kind == 1 and len(text) > 1:
                del text[at]
            else:
                text[at : at + int(kind == 0)] = [int(rng.integers(1 << 62))]
        text = text[:n]
        flat += [item, np.array(text, _U)]
        sizes += [n, len(text)]
    ends = np.cumsum(sizes)
    for tables in TABLES:
        key = embed(np.concatenate(flat), ends - sizes, ends, np.full(len(sizes), n), tables)
        if (key[::2] == key[1::2]).any(1).mean() >= recall:
            return tables
    return 0


def item_groups(items: DataFrame, most_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in groups of at most most_bytes of text; one group is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text) * 4 + 64
        if size >= most_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, recall: float = 0.99, most_bytes: int = 64 << 20) -> DataFrame:
    """MATCHES: one row for each document and item that match, at the best place."""
    spark = docs.sparkSession
    out = None
    for ids, texts in item_groups(items, most_bytes):
        sent = spark.sparkContext.broadcast((ids, texts, planned(texts, recall)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*sent.value)
                for part in words.slices(batch, "text", 1 << 21):
                    best = index.matches(part.column("text"))
                    doc_id = part.column("doc_id").to_pylist()
                    rows = [(doc_id[row], i, *found) for (row, k), found in best.items() for i in index.ids[k]]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def remove(docs: DataFrame, items: DataFrame, recall: float = 0.99, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs that match no item, with the columns of docs; the verdict is made where the row is, so nothing is shuffled."""
    spark = docs.sparkSession
    kept = docs
    for ids, texts in item_groups(items, most_bytes):
        sent = spark.sparkContext.broadcast((ids, texts, planned(texts, recall)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*sent.value)
                for part in words.slices(batch, "text", 1 << 21):
                    clean = np.ones(part.num_rows, bool)
                    clean[[row for row, _ in index.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


__all__ = ["Index", "bound", "edit_distances", "embed", "remove", "search", "tables_for"]
