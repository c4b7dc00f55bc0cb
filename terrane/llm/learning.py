"""What the two classifiers share: folds, a bounded sample of labelled rows, and the loss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 4000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows, and rows without id, teach no labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of at most per_class rows of each class, and the weight of a row of each class.

    Only labels that aren't held out are seen, and of them 0 and 1; of an id's several labels 1 wins, and a null label or
    id teaches nothing. The rows are those with the smallest hash of their id, so reruns agree; of documents that share an
    id the one with the smallest text teaches, so repeated ids don't add rows. Empty tables give no rows. The weights
    restore the classes' shares among all labels that may be learnt from. The chosen labels are few by construction and
    broadcast; documents are scanned once.
    """
    known = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = some[0].unionByName(some[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    total = sum(share.values()) or 1
    return rows, {c: share.get(c, 0) / total / max(1, min(per_class, share.get(c, 0))) for c in (0, 1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_loss(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.sum(weight * (np.logaddexp(0, logit) - y * logit)) / np.sum(weight))


class Adam:
    """Steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = ([np.zeros_like(a) for a in arrays] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
