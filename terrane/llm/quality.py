"""A quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, mix, release, slices, spans_hash, text_bytes
from .learning import ROWS_PER_CLASS, Adam, held_out, log_loss, sigmoid, training_rows

#: Hashed words; shapes of words (which are words of a second kind); length of a vector; neighbours on each side.
WORDS, SHAPES, SIZE, REACH = 1 << 16, 512, 64, 2
HIDDEN, EPOCHS = 32, 60
STEP = 1 << 20
#: Words whose neighbours are summed at once.
TOGETHER = 1 << 21

_U = np.uint64
#: 1: letters, digits and bytes of other than ASCII characters; 2: other visible characters. A word is of one kind.
_KINDS = np.array([1 if chr(b).isalnum() or b >= 0x80 else 0 if b <= 0x20 or b == 0x7F else 2 for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.int64)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)], np.int64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch as hash numbers, their shapes, and first[d]:first[d + 1] as the range of text d.

    A shape tells kind, capitals, digits, length, and whether the word and the one before it stood in the text before.
    """
    data, at = text_bytes(texts)
    w = Words(data, at, _KINDS)
    h = spans_hash(data, w.start, w.end)
    upper, digit = (np.r_[0, np.cumsum(x[data])] for x in (_UPPER, _DIGIT))
    size = w.end - w.start
    n_upper = upper[w.end] - upper[w.start]
    begins = _UPPER[data[w.start]]
    pair = h.copy()
    pair[1:] += h[:-1] * _U(0x9E3779B97F4A7C15)
    pair = mix(pair + w.doc.astype(_U) * _U(0xD6E8FEB86659FD93))
    again = np.ones(len(h), bool)
    again[np.unique(pair, return_index=True)[1]] = False
    shape = _KINDS[data[w.start]].astype(np.int64) - 1
    for bit in (again, n_upper == size, begins, digit[w.end] > digit[w.start]):
        shape = shape * 2 + bit
    return (h & _U(WORDS - 1)).astype(np.int64), shape * 16 + np.minimum(size, 16) - 1, w.first


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors of unit length: the places of the four of SIZE components that are not 0, and their values."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((n, SIZE)), axis=1)[:, :4]
    return place, rng.choice(np.float32([-0.5, 0.5]), (n, 4))


def context_vectors(n: int, streams: list[np.ndarray], seed: int) -> np.ndarray:
    """For each word the sum of its own index vector and those of its neighbours, over all streams, of unit length."""
    place, value = index_vectors(n, seed)
    out = np.zeros((n, SIZE))
    np.put_along_axis(out, place, value, 1)
    out = out.ravel()
    size = np.array([len(s) for s in streams], np.int64)
    part = np.cumsum(size) // TOGETHER
    for g in np.unique(part):
        some = np.flatnonzero(part == g)
        word = np.concatenate([streams[i] for i in some]).astype(np.int64)
        text = np.repeat(some, size[some])
        for k in range(1, REACH + 1):
            near = text[k:] == text[:-k]
            a, b = word[k:][near], word[:-k][near]
            for x, y in ((a, b), (b, a)):
                for j in range(4):
                    out += np.bincount(x * SIZE + place[y, j], value[y, j], n * SIZE)
    out = out.reshape(n, SIZE).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(table: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of table over the words of each text; 0 for a text without words."""
    n = np.diff(first)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[word], first[:-1][some], axis=0) / n[some, None]
    return out


@dataclass
class Network:
    """The first layer is linear in the mean of word vectors, so it is kept as a table of words (and of shapes)."""

    words: np.ndarray
    shapes: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def logits(self, word: np.ndarray, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        hidden = pooled(self.words, word, first) + pooled(self.shapes, shape, first) + self.bias
        return (np.maximum(hidden, 0) @ self.out + self.out_bias) / self.temperature


def fit_network(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> Network:
    """Fitted on (words, shapes) of texts. Each fifth text is kept back to set the temperature."""
    tables = [context_vectors(n, [t[i] for t in texts], seed + i) for i, n in enumerate((WORDS, SHAPES))]
    first = np.r_[0, np.cumsum([len(t[0]) for t in texts])].astype(np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *(t[i] for t in texts)]).astype(np.int64) for i in (0, 1)]
    parts = []
    for table, ids in zip(tables, flat, strict=True):
        rows = [pooled(table, ids[first[a] : first[min(a + 256, len(texts))]], first[a : a + 257] - first[a]) for a in range(0, len(texts), 256)]
        parts.append(np.concatenate([np.zeros((0, SIZE), np.float32), *rows]))
    x = np.concatenate(parts, 1).astype(np.float64)
    prior = float(np.sum(weight * y) / np.sum(weight)) if len(y) else 0.5
    base = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    if not len(y) or not 0 < y.mean() < 1:
        flat_out = np.zeros((1, HIDDEN), np.float32)
        return Network(np.repeat(flat_out, WORDS, 0), np.repeat(flat_out, SHAPES, 0), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), base, 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array([0.0])
    back = np.arange(len(y)) % 5 == 0
    w = weight / weight[~back].mean()
    learn = np.flatnonzero(~back)
    adam = Adam([w1, b1, w2, b2], 0.003)
    for _ in range(EPOCHS):
        turn = rng.permutation(learn)
        for low in range(0, len(turn), 256):
            r = turn[low : low + 256]
            a = z[r] @ w1 + b1
            hid = np.maximum(a, 0)
            g = (sigmoid(hid @ w2 + b2) - y[r]) * w[r] / len(r)
            ga = np.outer(g, w2) * (a > 0)
            adam.step([z[r].T @ ga + 1e-3 * w1, ga.sum(0), hid.T @ g + 1e-3 * w2, np.array([g.sum()])])
    logit = np.maximum(z[back] @ w1 + b1, 0) @ w2 + b2
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    heat = grid[int(np.argmin([log_loss(logit / t, y[back], w[back]) for t in grid]))] if 0 < y[back].mean() < 1 else 1.0
    w1 = w1 / spread[:, None]
    return Network((tables[0] @ w1[:SIZE]).astype(np.float32), (tables[1] @ w1[SIZE:]).astype(np.float32), (b1 - mean @ w1).astype(np.float32), w2, float(b2[0]), float(heat))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS) -> Network:
    """A network for labels (doc_id, label) of documents (doc_id, text), from at most per_class rows of each class.

    Words are numbered where the rows are; their numbers, bounded by the sample, come to the driver. Without labels of
    both classes the score is a constant. Other columns are ignored; see training_rows for repeated rows and nulls.
    """
    rows, weights = training_rows(docs, labels, label, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            word, shape, first = words(b.column("text"))
            cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            both = [pa.array([x.astype(np.uint16)[a:z].tobytes() for a, z in cut], pa.binary()) for x in (word, shape)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), *both], ["doc_id", "label", "words", "shapes"])

    got = sorted(rows.select("doc_id", "text", "label").mapInArrow(extract, "doc_id long, label int, words binary, shapes binary").collect(), key=lambda r: (r["doc_id"], r["words"]))
    y = np.array([r["label"] for r in got], float)
    texts = [(np.frombuffer(r["words"], np.uint16), np.frombuffer(r["shapes"], np.uint16)) for r in got]
    network = fit_network(texts, y, np.array([weights[int(v)] for v in y]))
    del got, texts
    release()
    return network


def score(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of (doc_id, text, ...).

    Only the text enters the score. A null text counts as empty; a text without words has the score of an empty mean.
    Repeated rows score alike, and a score equal to the threshold is predicted 1; an empty table gives an empty result;
    a very long text is taken whole, in a step of its own; other columns are ignored. The model's size is fixed by WORDS, SHAPES and HIDDEN, so it
    is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            p = sigmoid(model.value.logits(*words(b.column("text"))).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
