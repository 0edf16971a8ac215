"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network in numpy.

Words and word shapes (letter case, marks, digits, length, equal to the word before) fall into fixed
cells by hash. A cell's vector is the sum of sparse random index vectors of the cells within two words
of it, over the training texts (random indexing), scaled to unit length. A document is the weighted mean
of its words' vectors, the mean of its shapes' vectors and the logarithm of its length. A network with
one hidden layer is trained on the labelled documents; a temperature fitted on a fifth of them that the
training doesn't see calibrates the probabilities.

Labelled rows are a bounded sample: the `most_rows` (20,000) with the least hash of doc_id. The model
is about 8 MB whatever the input. Only the text is an input of a score.

Defined cases: a null text is an empty text and gets the network's answer for no words; repeated rows
are scored one by one; labels of one document that differ count as 0; null labels are left out; with
fewer than two classes among the labels every score is the smoothed share of label 1; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diglot.llm import words
from diglot.storage import materialise

CELLS, SHAPES, DIM, NEAR, HIDDEN = 1 << 14, 512, 48, 2, 24
_MARKS, _UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_MARKS[list(b"#*$%&|<>!=+@^_~\\{}[]/")] = True
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True


def index_vectors() -> np.ndarray:
    """A fixed sparse vector with four entries of +1 or -1 for each cell and shape."""
    cell = np.arange(CELLS + SHAPES, dtype=np.uint64)
    out = np.zeros((len(cell), DIM), np.float32)
    for k in range(4):
        h = words.mix(cell * np.uint64(8) + np.uint64(k + 1))
        out[np.arange(len(cell)), (h % np.uint64(DIM)).astype(int)] += np.where((h >> np.uint64(33)) & np.uint64(1), 1, -1)
    return out


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, words.Words]:
    """The cell and the shape of each word."""
    w = words.split(column, lower=False)
    data = w.data
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w
    lowered = words.split(column, lower=True)
    cell = (lowered.hash & np.uint64(CELLS - 1)).astype(np.int64)
    some = lambda table: np.add.reduceat(np.append(table[data], False).astype(np.int32), np.stack([w.first, w.last], 1).ravel())[::2] > 0
    length = w.last - w.first
    again = np.zeros(len(w.hash), bool)
    again[1:] = (lowered.hash[1:] == lowered.hash[:-1]) & (w.row[1:] == w.row[:-1])
    shape = (length > 1).astype(np.int64) + (length > 4) + (length > 8) + (length > 16) + (length > 32)
    for flag in (some(_UPPER), some(_LOWER), some(_DIGIT), some(_MARKS), again):
        shape = shape * 2 + flag
    return cell, shape % SHAPES, w


def _near_sums(cell: np.ndarray, shape: np.ndarray, row: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word, the index vectors of its neighbours in the same text, summed."""
    own = index[cell] + index[CELLS + shape]
    out = np.zeros_like(own)
    for k in range(1, NEAR + 1):
        same = (row[k:] == row[:-k])[:, None]
        out[k:] += own[:-k] * same
        out[:-k] += own[k:] * same
    return out


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    keys, first = np.unique(at[order], return_index=True)
    target[keys] += np.add.reduceat(rows[order], first, axis=0)


def word_vectors(texts: DataFrame, parts: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and weights of all cells and shapes from a bounded table of texts.

    Each of `parts` tasks sends one matrix of about 3 MB to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total, seen = np.zeros_like(index), np.zeros(len(index))
        for batch in batches:
            for rows in words.slices(batch, "text"):
                cell, shape, w = cells(rows.column("text"))
                if len(cell):
                    near = _near_sums(cell, shape, w.row, index)
                    _add_rows(total, cell, near)
                    _add_rows(total, CELLS + shape, near)
                    seen += np.bincount(cell, minlength=len(seen)) + np.bincount(CELLS + shape, minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["total", "seen"])

    got = texts.select("text").repartition(parts).mapInArrow(run, "total binary, seen binary").collect()
    total = np.sum([np.frombuffer(r.total, np.float32) for r in got], 0).reshape(-1, DIM)
    seen = np.sum([np.frombuffer(r.seen, np.float64) for r in got], 0)
    norm = np.sqrt((total**2).sum(1, keepdims=True))
    share = seen / max(1.0, seen[:CELLS].sum())
    weight = np.where(seen > 0, 0.02 / (0.02 + share), 0.0)
    weight[CELLS:] = 1.0
    return (total / np.where(norm == 0, 1, norm)).astype(np.float32), weight.astype(np.float32)


def _pool(column: pa.Array, lexical: np.ndarray, shapes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted mean of the rows of `lexical` (already times weight), mean of those of `shapes`, log length."""
    cell, shape, w = cells(column)
    n = len(w.count)
    a, b = np.zeros((n, lexical.shape[1]), np.float32), np.zeros((n, shapes.shape[1]), np.float32)
    some = np.flatnonzero(w.count)
    if len(some):
        first = w.bounds()[:-1][some]
        total = np.add.reduceat(weight[cell], first)
        a[some] = np.add.reduceat(lexical[cell], first, axis=0) / np.where(total == 0, 1, total)[:, None]
        hist = np.bincount(np.repeat(np.arange(n), w.count) * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
        b = (hist / np.maximum(w.count, 1)[:, None]).astype(np.float32) @ shapes
    return a, b, np.log1p(w.count)


def pooled(texts: DataFrame, vectors: np.ndarray, weight: np.ndarray) -> DataFrame:
    """doc_id, quality and the document vector of a bounded table of labelled texts."""
    sent = texts.sparkSession.sparkContext.broadcast((vectors, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, wt = sent.value
        lexical = v[:CELLS] * wt[:CELLS, None]
        for batch in batches:
            for rows in words.slices(batch, "text"):
                x = np.concatenate([*(p if p.ndim == 2 else p[:, None] for p in _pool(rows.column("text"), lexical, v[CELLS:], wt[:CELLS]))], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, x binary")


class Network:
    """inputs -> tanh -> one logit, with standardised inputs, trained by Adam."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        # inputs that hardly vary in training must not decide a score
        self.mean, self.scale = x[~held].mean(0), np.sqrt(x[~held].var(0) + 0.03**2)
        z = (x - self.mean) / self.scale
        p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 256):
                at = train[i : i + 256]
                h = np.tanh(z[at] @ p[0] + p[1])
                out = (h @ p[2] + p[3])[:, 0]
                d = ((1 / (1 + np.exp(-out)) - y[at]) / len(at))[:, None]
                dh = d @ p[2].T * (1 - h**2)
                grads = [z[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(0)]
                step += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] -= 0.005 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        self.temperature = 1.0
        if held.any() and len(np.unique(y[held])) > 1:
            logit = self.logit(x[held])
            loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t))
            self.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])[:, 0]

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """The first layer as one matrix and an offset on inputs that aren't standardised."""
        w = self.p[0] / self.scale[:, None]
        return w, self.p[1] - self.mean @ w


def held_out(folds: int = 5, id_col: str = "doc_id"):
    """True for rows whose crc32 of doc_id as text is divisible by folds; never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, folds: int, most_rows: int) -> DataFrame:
    """At most most_rows labelled texts: doc_id, quality, text. Only the chosen ids are broadcast (16 bytes each)."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(folds))
    ids = materialise(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "sample-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return materialise(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; the scoring is one pass without a shuffle."""
    spark = docs.sparkSession
    texts = sample(docs, labels, folds, most_rows)
    vectors, weight = word_vectors(texts)
    rows = pooled(texts, vectors, weight).collect()
    model = None
    rate = 0.5
    if rows:
        rows.sort(key=lambda r: r.doc_id)
        x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
        y = np.array([r.quality for r in rows], float)
        rate = (y.sum() + 1) / (len(y) + 2)
        held = words.mix(np.array([r.doc_id for r in rows], np.int64).view(np.uint64)) % np.uint64(5) == 0
        if len(np.unique(y[~held])) == 2:
            net = Network(x, y, held)
            first, offset = net.folded()
            lexical = (vectors[:CELLS] * weight[:CELLS, None]) @ first[:DIM]
            shapes = vectors[CELLS:] @ first[DIM : 2 * DIM]
            model = (lexical.astype(np.float32), shapes.astype(np.float32), weight[:CELLS], first[2 * DIM], offset, net.p[2], net.p[3], net.temperature)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in words.slices(batch, "text"):
                if m is None:
                    p = np.full(part.num_rows, rate)
                else:
                    lexical, shapes, wt, by_length, offset, second, last, temperature = m
                    a, b, n = _pool(part.column("text"), lexical, shapes, wt)
                    h = np.tanh(a + b + n[:, None] * by_length + offset)
                    p = 1 / (1 + np.exp(-np.clip((h @ second + last)[:, 0] / temperature, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held_out"), "text")
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
