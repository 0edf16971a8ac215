"""LM scoring with a weighted backoff automaton, without a model in one place.

The model is a trigram model with hierarchical Dirichlet smoothing, which needs counts of n-grams only:

    p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),  p2(w | b) = (c(b w) + mu2 p1(w)) / (c(b) + mu2),
    p3(w | a b) = (c(a b w) + mu3 p2(w | b)) / (c(a b) + mu3)

As an automaton: the root, a state for each seen word and one for each seen pair. Each seen n-gram is an
arc of its context's state with its smoothed probability, and leads to the state of the longest seen end of
what was read. Each state has a failure arc to the state without its first word, with the weight
mu / (c + mu); the root has an arc for every word. One traversal from left to right carries the state,
follows failure arcs until the word has an arc, and adds up log10 probabilities. A state depends on the last
two tokens only, so a text may be cut anywhere: each piece runs in two tokens earlier, and all pieces of a
block are traversed side by side.

The counts of a corpus don't fit one machine, so each block of documents gets just the automaton that
its own texts can reach:

1. Documents are written as compressed blocks of some MB, several in a file; tables hold their places.
2. Each block sends the distinct words and pairs of its texts, with its training counts, as sorted arrays
   cut into hash ranges, and gets the totals back, with a mark for what other blocks sent too.
3. The same for trigrams, but only for those whose two pairs other blocks have too: the total of any other
   is the block's own count.
4. A block and its answers meet; the block builds its automaton and scores its documents.

A frequent n-gram is one entry a block, so no range is hot. A block has FAN ranges at most, whatever the
corpus. Where a range is more than a task should hold, the chunks of some blocks are merged, and the merged
chunk asks in turn, over FAN ranges of its range (`exchange`); so rows stay in proportion to the corpus.

Nothing is pruned, capped or sampled. N-grams are 63-bit hashes. Defined cases: a null text is empty and
scores its end token only; a very long text is a block of its own; a null doc_id counts as held out; repeated
rows are counted and scored one by one; with no training rows all counts are 0; other columns, whatever their
names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.storage import fresh_path, materialise

MU = (100.0, 3.0)
BLOCK, RANGE, FAN, PIECE = 7 << 20, 24 << 20, 64, 256
_U = np.uint64
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C1B2A593)
BLOCKS = "block long, text_bytes long, place string, n_docs long"
ASKED = "block long, bucket int, keys binary, counts binary, n long"
ANSWERS = "block long, bucket int, totals binary, n long, words long, tokens long"
MERGED = "block long, low long, keys binary, counts binary, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _zip(raw: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def pack_numbers(values: np.ndarray) -> bytes:
    """Sorted or small 64-bit numbers, as differences by byte planes; about 5 bytes for a hash."""
    steps = np.diff(values, prepend=_U(0))
    return _zip(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(8, n)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U)


def pack_counts(values: np.ndarray) -> bytes:
    """Numbers by byte planes, as many planes as the greatest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return _zip(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


# ---- blocks of documents ----


class Tokens(NamedTuple):
    """A block's documents as one run of tokens: the last of each document is its end."""

    doc_id: list
    held: np.ndarray
    word: np.ndarray
    row: np.ndarray
    start: np.ndarray


def tokens(raw: bytes) -> Tokens:
    rows = pa.ipc.open_stream(_unzip(raw)).read_all().combine_chunks().to_batches()[0]
    w = words.split(rows.column("text"), lower=True)
    row = np.repeat(np.arange(len(w.count)), w.count + 1)
    last = np.cumsum(w.count + 1) - 1
    word = np.empty(len(row), _U)
    inner = np.ones(len(row), bool)
    inner[last] = False
    word[inner], word[last] = w.hash, END
    start = np.zeros(len(row), bool)
    start[last - w.count] = True
    return Tokens(rows.column("doc_id").to_pylist(), rows.column("held_out").to_numpy(zero_copy_only=False), word, row, start)


def write_blocks(docs: DataFrame, folds: int) -> DataFrame:
    """Writes the documents as compressed blocks, one file a task, and gives the table of BLOCKS; a document is never cut."""
    folder = fresh_path(docs.sparkSession, "lm-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[tuple] = []
        size = at = 0
        out = path = None

        def flush() -> None:
            nonlocal size, at, out, path, held
            if not held:
                return
            if out is None:
                path = f"{folder}/part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
                where, name = pafs.FileSystem.from_uri(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(name)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            raw = _zip(sink.getvalue().to_pybytes(), 3)
            out.write(raw)
            done.append(((TaskContext.get().partitionId() << 32) + len(done), size, f"{at} {len(raw)} {path}", sum(p.num_rows for p in held)))
            at, size, held = at + len(raw), 0, []

        for batch in batches:
            for part in words.slices(batch, "text", 1 << 20):
                held.append(part)
                size += int(words.text_bytes(part.column("text"))[1][-1])
                if size >= BLOCK:
                    flush()
        flush()
        if out is not None:
            out.close()
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=_names(BLOCKS))

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), F.col("text").alias("text"))
    return materialise(chosen.mapInArrow(run, BLOCKS), "lm-places")


def read_block(place: str) -> Tokens:
    at, size, path = place.split(" ", 2)
    where, name = pafs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        f.seek(int(at))
        return tokens(f.read(int(size)))


# ---- the n-grams of a block ----


class Ranked(NamedTuple):
    """Distinct keys in ascending order, each token's place among them, and some token of each."""

    keys: np.ndarray
    place: np.ndarray
    some: np.ndarray


def ranked(keys: np.ndarray) -> Ranked:
    order = np.argsort(keys)
    in_order = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return Ranked(in_order[new], place, order[new])


def before(t: Tokens) -> np.ndarray:
    """The word before each token, BEGIN at a document's start."""
    out = np.empty_like(t.word)
    out[1:] = t.word[:-1]
    out[t.start] = BEGIN
    return out


def word_grams(t: Tokens) -> Ranked:
    return ranked(words.mix(t.word) & ~_U(1))


def pair_grams(t: Tokens) -> Ranked:
    return ranked(words.pair(before(t), t.word) | _U(1))


def triple_grams(t: Tokens, pairs: Ranked) -> tuple[Ranked, np.ndarray, np.ndarray]:
    """The trigrams of all tokens but each document's first; those tokens; and for each trigram the pairs of its context and of its end."""
    at = np.flatnonzero(~t.start)
    key = pairs.keys[pairs.place]
    found = ranked(words.pair(key[at - 1], key[at]))
    return found, at, np.stack([pairs.place[at[found.some] - 1], pairs.place[at[found.some]]])


# ---- asking for totals ----


def cuts(keys: np.ndarray, low: int, level: int, fan: int) -> np.ndarray:
    """Where each of `fan` equal parts of a range begins in ascending keys; the range is the low-th of fan**level."""
    width = -(-(1 << 64) // fan ** (level + 1))
    first = low * fan
    starts = np.array([min((first + b) * width, (1 << 64) - 1) for b in range(1, fan)], _U) if fan > 1 else np.zeros(0, _U)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def asking(block: int, keys: np.ndarray, counts: np.ndarray, low: int, level: int, fan: int) -> pa.RecordBatch:
    """A block's keys as rows of ASKED, one for each part of its range that it has keys in."""
    edges = cuts(keys, low, level, fan)
    some = np.flatnonzero(np.diff(edges))
    spans = [slice(edges[b], edges[b + 1]) for b in some]
    columns = [pa.array([block] * len(some), pa.int64()), pa.array(low * fan + some, pa.int32()), pa.array([pack_numbers(keys[s]) for s in spans], pa.binary()), pa.array([pack_counts(counts[s]) for s in spans], pa.binary()), pa.array(np.diff(edges)[some], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=_names(ASKED))


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([unpack_numbers(k.as_py(), n) for k, n in zip(table.column("keys"), sizes, strict=True)])
    return keys, np.concatenate([unpack_counts(c.as_py(), n) for c, n in zip(table.column("counts"), sizes, strict=True)]), sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their sums, and the place of each given key."""
    r = ranked(keys)
    total = np.zeros(len(r.keys), np.int64)
    np.add.at(total, r.place, counts)
    return r.keys, total, r.place


def _answer(table: pa.Table) -> pa.Table:
    """For each block the totals of its keys, doubled, plus 1 where another block has the key; the first row also has the range's distinct words and tokens."""
    keys, counts, sizes = _opened(table)
    # counts come as (count of merged blocks' training tokens) * 2 + (several blocks have it)
    distinct, total, place = _summed(keys, counts >> 1)
    shared = np.bincount(place, minlength=len(distinct)) > 1
    shared |= np.bincount(place, counts & 1, len(distinct)) > 0
    back = (total * 2 + shared)[place]
    word = (distinct & _U(1)) == 0
    rows = table.num_rows
    found, seen = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    found[0], seen[0] = (word & (total > 0)).sum(), total[word].sum()
    return pa.table([table.column("block"), table.column("bucket"), pa.array([pack_counts(p) for p in np.split(back, np.cumsum(sizes)[:-1])], pa.binary()), table.column("n"), pa.array(found), pa.array(seen)], names=_names(ANSWERS))


def _merge(table: pa.Table) -> pa.Table:
    """The chunks of some blocks in one range as one chunk of MERGED."""
    keys, counts, _ = _opened(table)
    distinct, total, place = _summed(keys, counts >> 1)
    shared = (np.bincount(place, minlength=len(distinct)) > 1) | (np.bincount(place, counts & 1, len(distinct)) > 0)
    return pa.table([table.column("part")[:1], pa.array([table.column("bucket")[0].as_py()], pa.int64()), pa.array([pack_numbers(distinct)], pa.binary()), pa.array([pack_counts(total * 2 + shared)], pa.binary()), pa.array([len(distinct)])], names=_names(MERGED))


def exchange(asked: DataFrame, size: int, level: int = 0, fan: int = FAN, most: int = RANGE) -> DataFrame:
    """ANSWERS to ASKED rows of about `size` bytes in all, whose buckets are the fan**(level+1) parts of all hashes.

    If a bucket is within `most` bytes it is one task. Else each bucket's chunks are merged in groups of
    that size, by the hash of their blocks; each merged chunk asks for itself, and its answers are handed down.
    """
    if size <= most * fan ** (level + 1):
        tasks = max(8, min(fan ** (level + 1), size // (most // 6)))
        return materialise(asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERS), "lm-answers")
    kept = materialise(asked, "lm-chunks")
    groups = -(-size // (most * fan ** (level + 1)))
    part: Column = (F.col("bucket").cast("long") * groups + F.pmod(F.xxhash64("block"), F.lit(groups))).alias("part")
    named = kept.select("*", part)
    merged = materialise(named.groupBy("part").applyInArrow(_merge, MERGED), "lm-merged")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield asking(r["block"], unpack_numbers(r["keys"], r["n"]), unpack_counts(r["counts"], r["n"]), r["low"], level + 1, fan)

    above = exchange(merged.mapInArrow(ask, ASKED), size, level + 1, fan, most)

    def hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        totals = np.concatenate([unpack_counts(right.column("totals")[int(i)].as_py(), right.column("n")[int(i)].as_py()) for i in order])
        keys, _, sizes = _opened(left)
        distinct, place = np.unique(keys, return_inverse=True)
        if len(distinct) != len(totals):
            raise ValueError(f"{len(distinct)} n-grams, {len(totals)} answers")
        rows = left.num_rows
        found, seen = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        found[0], seen[0] = sum(right.column("words").to_pylist()), sum(right.column("tokens").to_pylist())
        return pa.table([left.column("block"), left.column("bucket"), pa.array([pack_counts(p) for p in np.split(totals[place], np.cumsum(sizes)[:-1])], pa.binary()), left.column("n"), pa.array(found), pa.array(seen)], names=_names(ANSWERS))

    both = named.groupBy("part").cogroup(above.withColumnRenamed("block", "part").groupBy("part"))
    return materialise(both.applyInArrow(hand_down, ANSWERS), "lm-answers")


def _ask_words_and_pairs(blocks: DataFrame, fan: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, place in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), strict=True):
                t = read_block(place)
                learnt = ~t.held[t.row]
                own = [(g.keys, np.bincount(g.place[learnt], minlength=len(g.keys))) for g in (word_grams(t), pair_grams(t))]
                keys = np.concatenate([k for k, _ in own])
                order = np.argsort(keys)
                yield asking(block, keys[order], np.concatenate([c for _, c in own])[order] * 2, 0, 0, fan)

    return spread(blocks.select("block", "place"), blocks).mapInArrow(run, ASKED)


def spread(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows by block, some blocks to a task: adaptive execution would go by the rows' size, but what they stand for is larger."""
    return rows.repartition(max(8, -(-blocks.count() // 3)), "block")


class Totals(NamedTuple):
    """A block's tokens and grams with the totals of its words and pairs, and which pairs other blocks have."""

    t: Tokens
    word: Ranked
    pair: Ranked
    of_word: np.ndarray
    of_pair: np.ndarray
    shared: np.ndarray


def with_totals(place: str, answers: dict[int, tuple[bytes, int]]) -> Totals:
    """Reads a block and puts its answers (bucket -> totals, how many) in their places."""
    t = read_block(place)
    word, pair = word_grams(t), pair_grams(t)
    got = np.concatenate([unpack_counts(*answers[b]) for b in sorted(answers)])
    if len(got) != len(word.keys) + len(pair.keys):
        raise ValueError(f"{len(word.keys) + len(pair.keys)} n-grams, {len(got)} answers")
    order = np.argsort(np.concatenate([word.keys, pair.keys]))
    back = np.empty_like(got)
    back[order] = got
    k = len(word.keys)
    return Totals(t, word, pair, back[:k] >> 1, back[k:] >> 1, (back[k:] & 1) == 1)


def _by_block(blocks: DataFrame, *answers: DataFrame):
    """The places of the blocks and the answers of each, grouped by block; `round` is -1, 0, 1 ..."""
    rows = blocks.select("block", F.lit(-1).alias("round"), F.lit(0).alias("bucket"), F.col("place").cast("binary").alias("data"), F.lit(0).cast("long").alias("n"))
    for k, a in enumerate(answers):
        rows = rows.unionByName(a.select("block", F.lit(k).alias("round"), "bucket", F.col("totals").alias("data"), "n"))
    return spread(rows, blocks).groupBy("block")


def _received(table: pa.Table) -> tuple[int, str, list[dict[int, tuple[bytes, int]]]]:
    place, out = "", [{}, {}]
    for k, b, d, n in zip(table.column("round").to_pylist(), table.column("bucket").to_pylist(), table.column("data"), table.column("n").to_pylist(), strict=True):
        if k < 0:
            place = d.as_py().decode()
        else:
            out[k][b] = d.as_py(), n
    return table.column("block")[0].as_py(), place, out


def asked_triples(x: Totals) -> tuple[Ranked, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trigrams of a block, their pairs, own training counts, those tokens, and which must be asked for."""
    found, at, ends = triple_grams(x.t, x.pair)
    own = np.bincount(found.place[~x.t.held[x.t.row[at]]], minlength=len(found.keys))
    return found, ends, own, at, x.shared[ends[0]] & x.shared[ends[1]]


def _ask_triples(blocks: DataFrame, first: DataFrame, fan: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        block, place, (answers, _) = _received(table)
        found, _, own, _, open_ = asked_triples(with_totals(place, answers))
        return pa.Table.from_batches([asking(block, found.keys[open_], own[open_] * 2, 0, 0, fan)])

    return _by_block(blocks, first).applyInArrow(run, ASKED)


# ---- the automaton ----


class Automaton:
    """States 0 (root), 1 + word, 1 + words + 1 + pair; arcs sorted by state and word; a failure arc for each state but the root.

    words: counts of the words; begin: count of documents, the context at a start (its word is the last).
    pairs: counts, first word and second word; triples: counts, the pair of the context, the pair of the end.
    """

    def __init__(self, words_: np.ndarray, begin: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, vocabulary: int, end: int, mu: tuple[float, float] = MU):
        k = len(words_)
        count, first, second = pairs
        total, context, tail = triples
        self.wide = k + 1
        one = (words_ + 0.1) / (n + 0.1 * (vocabulary + 1))
        context_count = np.append(words_, begin)
        two = (count + mu[0] * one[second]) / (context_count[first] + mu[0])
        three = (total + mu[1] * two[tail]) / (count[context] + mu[1])
        self.root = np.log10(one)
        self.known = np.where((words_ > 0) & (np.arange(k) != end), 1 + np.arange(k), 0)
        self.fail_weight = np.log10(np.concatenate([[1.0], mu[0] / (context_count + mu[0]), mu[1] / (count + mu[1])]))
        self.fail = np.concatenate([[0], np.zeros(k + 1, np.int64), self.known[second]])
        pair_state = np.where((count > 0) & (second != end), 2 + k + np.arange(len(count)), 0)
        a, b = np.flatnonzero(count > 0), np.flatnonzero(total > 0)
        arc = np.concatenate([(1 + first[a]) * self.wide + second[a], (2 + k + context[b]) * self.wide + second[tail[b]]])
        order = np.argsort(arc)
        self.arc = arc[order]
        self.weight = np.log10(np.concatenate([two[a], three[b]]))[order]
        self.target = np.concatenate([pair_state[a], pair_state[tail[b]]])[order]
        self.begin = 1 + k if begin else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word each, and its log10 probabilities."""
        state, out = state.copy(), np.zeros(len(state))
        live = np.arange(len(state))
        while len(live):
            at_root = state[live] == 0
            done = live[at_root]
            out[done] += self.root[word[done]]
            state[done] = self.known[word[done]]
            live = live[~at_root]
            if not len(live):
                break
            s = state[live]
            key = s * self.wide + word[live]
            at = np.minimum(np.searchsorted(self.arc, key), max(len(self.arc) - 1, 0))
            hit = self.arc[at] == key if len(self.arc) else np.zeros(len(live), bool)
            yes, no = live[hit], live[~hit]
            out[yes] += self.weight[at[hit]]
            state[yes] = self.target[at[hit]]
            out[no] += self.fail_weight[s[~hit]]
            state[no] = self.fail[s[~hit]]
            live = no
        return state, out

    def traverse(self, word: np.ndarray, start: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """The log10 probability of each token of a run of documents; start marks their first tokens."""
        n = len(word)
        out = np.zeros(n)
        begins = np.arange(0, n, piece)
        state = np.zeros(len(begins), np.int64)
        for j in range(-2, piece):
            at = begins + j
            inside = np.flatnonzero((at >= 0) & (at < n))
            at = at[inside]
            entered = np.where(start[at], self.begin, state[inside])
            state[inside], value = self.step(entered, word[at])
            if j >= 0:
                out[at] = value
        return out


def _score_block(table: pa.Table, n: int, vocabulary: int, mu: tuple[float, float]) -> pa.Table:
    _, place, (first, second) = _received(table)
    x = with_totals(place, first)
    found, ends, triple, _, open_ = asked_triples(x)
    if second:
        got = np.concatenate([unpack_counts(*second[b]) for b in sorted(second)])
        triple[open_] = got >> 1
    elif open_.any():
        raise ValueError(f"{int(open_.sum())} trigrams, no answer")
    t, word, pair = x.t, x.word.place, x.pair
    k = len(x.word.keys)
    end = int(word[len(word) - 1])
    before_word = np.full(len(pair.keys), k)
    inner = ~t.start[pair.some]
    before_word[inner] = word[pair.some[inner] - 1]
    model = Automaton(x.of_word, int(x.of_word[end]), (x.of_pair, before_word, word[pair.some]), (triple, ends[0], ends[1]), n, vocabulary, end, mu)
    rows = len(t.doc_id)
    base = np.bincount(t.row, model.root[word], rows)
    own = np.bincount(t.row, model.traverse(word, t.start), rows)
    known = np.bincount(t.row, x.of_word[word] > 0, rows).astype(np.int64)
    columns = [pa.array(t.doc_id, pa.int64()), pa.array(t.held), pa.array(np.bincount(t.row, minlength=rows)), pa.array(known), pa.array(np.full(rows, n)), pa.array(base), pa.array(own)]
    return pa.table(columns, names=_names(SCORES))


def score(docs: DataFrame, folds: int = 10, mu: tuple[float, float] = MU, fan: int = FAN, most: int = RANGE) -> DataFrame:
    """SCORES of every document under the model learnt from those that aren't held out."""
    blocks = write_blocks(docs, folds)
    size = int(blocks.agg(F.sum("text_bytes")).first()[0] or 0)
    first = exchange(_ask_words_and_pairs(blocks, fan), size, 0, fan, most)
    sums = first.agg(F.sum("words"), F.sum("tokens")).first()
    vocabulary, n = int(sums[0] or 0), int(sums[1] or 0)
    second = exchange(_ask_triples(blocks, first, fan), size // 2, 0, fan, most)
    return _by_block(blocks, first, second).applyInArrow(lambda table: _score_block(table, n, vocabulary, mu), SCORES)
