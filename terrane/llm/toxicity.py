"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, release, slices, spans_hash, text_bytes
from .learning import ROWS_PER_CLASS, Adam, held_out, sigmoid, training_rows

#: Bits of a hashed term.
TERM_BITS = 20
#: What a term shows by itself, or a pair of terms beyond both, in standard errors, to be learnt; and the share of the
#: texts that each term of a pair must be in to be tested with all others. Words of one language go together anyhow, so
#: pairs need more than single terms.
ALONE, TOGETHER, PAIR_SHARE = 4.0, 10.0, 0.05
FACTORS, EPOCHS = 8, 120

_U = np.uint64
#: Letters, digits and bytes of other than ASCII characters make up terms.
_KINDS = np.array([1 if chr(b).isalnum() or b >= 0x80 else 0 for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs of a batch, each once: lower-case words, and their first 4 to 6 bytes for words that go on."""
    data, at = text_bytes(pc.utf8_lower(texts.fill_null("")))
    w = Words(data, at, _KINDS)
    size = w.end - w.start
    found = [(w.doc, spans_hash(data, w.start, w.end))]
    for k in (4, 5, 6):
        longer = size > k
        start = w.start[longer]
        found.append((w.doc[longer], spans_hash(data, start, start + k) ^ _U(0x5851F42D4C957F2D * k & (1 << 64) - 1)))
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return doc, (h >> _U(64 - TERM_BITS)).astype(np.int64)


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of terms of the products of their factors; place: of each hashed term."""

    place: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        at = self.place[term]
        doc, at = doc[at >= 0], at[at >= 0]
        key = np.unique(doc * np.int64(len(self.weight) + 1) + at)
        return self._of(*np.divmod(key, len(self.weight) + 1), n)[0]

    def _of(self, doc: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[at]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], 1)
        own = np.bincount(doc, (v * v).sum(1), n)
        return self.bias[0] + np.bincount(doc, self.weight[at], n) + ((sums * sums).sum(1) - own) / 2, sums


def telling(doc: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The terms, in order, that tell the classes apart alone or with another one, of (doc, term) pairs, each once.

    Alone: by the share of positive texts among those that hold the term. Together: two terms that each stand in
    PAIR_SHARE of the texts are tested on the texts with both, against what their own shares add up to; so terms that
    are neutral by themselves are found. All such pairs are tested, by products of blocks of the text-term matrix.
    """
    n, share = len(y), y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.int64)
    held = np.bincount(term, minlength=1 << TERM_BITS)
    own = np.bincount(term, (y > 0)[doc], 1 << TERM_BITS)
    spread = share * (1 - share)
    able = (np.abs(own - held * share) - 0.5) / np.sqrt(np.maximum(held, 1) * spread) >= ALONE
    often = np.flatnonzero(held >= max(PAIR_SHARE * n, 1))
    column = np.full(1 << TERM_BITS, -1, np.int64)
    column[often] = np.arange(len(often))
    there = np.zeros((n, len(often)), bool)
    at = column[term] >= 0
    there[doc[at], column[term[at]]] = True
    beyond = own[often] / held[often] - share
    block, sign = 1024, (y > 0).astype(np.float32)[:, None]
    for low in range(0, len(often), block):
        a = there[:, low : low + block].astype(np.float32)
        for right in range(low, len(often), block):
            b = there[:, right : right + block].astype(np.float32)
            both = a.T @ b
            more = (a * sign).T @ b - both * (share + beyond[low : low + block, None] + beyond[None, right : right + block])
            hit = np.abs(more) >= TOGETHER * np.sqrt(np.maximum(both, 1) * spread)
            hit &= np.arange(low, low + len(hit))[:, None] != np.arange(right, right + hit.shape[1])
            able[often[low : low + block][hit.any(1)]] = True
            able[often[right : right + block][hit.any(0)]] = True
    return np.flatnonzero(able)


def fit_machine(doc: np.ndarray, term: np.ndarray, y: np.ndarray, row_weight: np.ndarray, seed: int = 7) -> Machine:
    """Fitted on (doc, term) pairs, each once, over the terms that are telling()."""
    n = len(y)
    share = y.mean() if n else 0.0
    able = telling(doc, term, y)
    place = np.full(1 << TERM_BITS, -1, np.int32)
    place[able] = np.arange(len(able))
    rng = np.random.default_rng(seed)
    m = Machine(place, np.zeros(1), np.zeros(len(able)), rng.normal(0, 0.02, (len(able), FACTORS)))
    prior = float(np.sum(row_weight * y) / max(np.sum(row_weight), 1e-12)) if n else 0.0
    m.bias[0] = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    if not len(able) or not 0 < share < 1:
        return m
    at = place[term]
    doc, at = doc[at >= 0], at[at >= 0].astype(np.int64)
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    # Rows weigh between their natural share and equal classes.
    w = (row_weight / row_weight.mean()) ** 0.25
    w /= w.mean()
    adam = Adam([m.bias, m.weight, m.factors], 0.02)
    for _ in range(EPOCHS):
        turn = rng.permutation(n)
        for low in range(0, n, 512):
            rows = turn[low : low + 512]
            size = first[rows + 1] - first[rows]
            take = np.repeat(first[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            d, a = np.repeat(np.arange(len(rows)), size), at[take]
            logit, sums = m._of(d, a, len(rows))
            g = (sigmoid(logit) - y[rows]) * w[rows] / len(rows)
            gd = g[d]
            gv = gd[:, None] * (sums[d] - m.factors[a])
            k = len(m.weight)
            adam.step([np.array([g.sum()]), np.bincount(a, gd, k) + 1e-4 * m.weight, np.stack([np.bincount(a, gv[:, f], k) for f in range(FACTORS)], 1) + 1e-4 * m.factors])
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS) -> Machine:
    """A machine for labels (doc_id, label) of documents (doc_id, text), from at most per_class rows of each class.

    Terms are extracted where the rows are; their numbers, bounded by the sample, come to the driver. Without labels of
    both classes the score is a constant. Other columns are ignored; see training_rows for repeated rows and nulls.
    """
    rows, weights = training_rows(docs, labels, label, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, term = terms(b.column("text"))
            key = np.unique(doc << TERM_BITS | term)
            cut = np.searchsorted(key, np.arange(b.num_rows + 1) << TERM_BITS)
            term = (key & ((1 << TERM_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), pa.array([term[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary())], ["doc_id", "label", "terms"])

    got = sorted(rows.select("doc_id", "text", "label").mapInArrow(extract, "doc_id long, label int, terms binary").collect(), key=lambda r: (r["doc_id"], r["terms"]))
    each = [np.frombuffer(r["terms"], np.int32) for r in got]
    y = np.array([r["label"] for r in got], float)
    doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in each])
    term = np.concatenate([*each, np.zeros(0, np.int32)])
    row_weight = np.array([weights[int(v)] for v in y])
    del got, each
    machine = fit_machine(doc, term, y, row_weight)
    del doc, term
    release()
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of (doc_id, text, ...).

    Only the text enters the score; a null text counts as empty and has the score of no terms. Repeated rows score
    alike, and a score equal to the threshold is predicted 1; an empty table gives an empty result; a very long text is
    taken whole, in a step of its own; other columns are ignored. The model's size is bounded by TERM_BITS, so it is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = sigmoid(model.value.logits(*terms(b.column("text")), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = sigmoid(model.value.logits(*terms(b.column("text")), b.num_rows))
            yield b.filter(pa.array(p < threshold)).select(names)

    return docs.mapInArrow(run, docs.schema)


__all__ = ["Machine", "fit", "fit_machine", "score", "telling", "terms", "without_toxic"]
