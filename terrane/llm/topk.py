"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

#: Queries and candidates that meet in one cell at most, queries scored together, and candidates scored at once.
QUERY_ROWS, GROUP_ROWS, CHUNK, BLOCK = 16384, 65536, 32, 2048
#: Share of a block's rows from which on a term's postings are kept as a dense row of weights.
DENSE = 0.25
#: Cells for each task, if the table is small enough for cells below the sizes above.
CELLS = 2

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: as 64-bit integers, or as Python's if a value is too large for products by scale."""
    if x.dtype.kind == "i":
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        fits = max(-low, high) * scale <= _MOST
        return x * np.int64(scale) if fits else x.astype(object) * scale
    large = np.abs(x) >= 2.0**52  # these are whole already
    if not large.any() and scale <= 1024:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if big else int(np.floor(v * scale)) for v, big in zip(x.tolist(), large.tolist(), strict=True)], object)


class Postings:
    """Inverted lists of a block of vectors, end to end in flat with offsets at: of each term the rows and weights."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.rows = len(at) - 1
        self.block: np.ndarray | None = None
        size = np.diff(at)
        row = np.repeat(np.arange(self.rows), size)
        term = np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)
        there = flat != 0
        order = np.argsort(term[there], kind="stable")
        self.row, self.weight = row[there][order], flat[there][order]
        terms, first = np.unique(term[there][order], return_index=True)
        self.lists = {int(t): slice(int(a), int(b)) for t, a, b in zip(terms, first, [*first[1:], len(order)], strict=True)}
        self.dense = [t for t, at in self.lists.items() if at.stop - at.start >= DENSE * self.rows]
        self.most = max((abs(int(x)) for x in (self.weight.min(), self.weight.max())), default=0) if len(self.weight) else 0

    def weights(self, terms: list[int], kind: type) -> np.ndarray:
        """The weights of some terms as dense rows, 0 where there is no posting."""
        out = np.zeros((len(terms), self.rows), kind)
        for i, t in enumerate(terms):
            if (at := self.lists.get(t)) is not None:
                out[i, self.row[at]] = self.weight[at]
        return out

    def scores(self, queries: Postings) -> np.ndarray:
        """Inner products of all queries with all rows, one term after the other: doubles if no sum can pass 53 bits, which
        they hold exactly, else 64-bit integers if none can pass 62, else Python's. In doubles the terms that many rows
        have are added together, as no order of such sums makes a difference."""
        most = self.most * queries.most * max(1, len(self.lists))
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        together = set(self.dense) if kind is np.float64 else set()
        out = np.zeros((queries.rows, self.rows), kind)
        if together:
            if self.block is None:
                self.block = self.weights(self.dense, kind)
            out += queries.weights(self.dense, kind).T @ self.block
        for t, q in queries.lists.items():
            if t in together or (at := self.lists.get(t)) is None:
                continue
            weight, by = self.weight[at].astype(kind, copy=False), queries.weight[q].astype(kind, copy=False)
            out[queries.row[q][:, None], self.row[at][None, :]] += by[:, None] * weight[None, :]
        return out


class Top:
    """The k highest scores so far of each query of a chunk, as (score, id), ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        self.least: list[int | None] = [None] * len(queries)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (queries, rows). A row with the query's id is its own and doesn't count."""
        # Scores that aren't Python's lie within 62 bits; a bound beyond may be cut to that.
        end = 1 << 62
        if score.dtype == object:
            least = np.array([-np.inf if v is None else v for v in self.least], object)
        else:
            least = np.array([-end if v is None else min(max(v, -end), end) for v in self.least], score.dtype)
        able = score >= least[:, None]
        if np.isin(self.queries, ids).any():
            able &= self.queries[:, None] != ids[None, :]
        for q in np.flatnonzero(able.any(1)).tolist():
            at = np.flatnonzero(able[q])
            s = score[q, at]
            if len(at) > self.k:  # a partition first, an exact order of what is left
                high = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                at, s = at[high], s[high]
            both = sorted([(-int(v), i) for v, i in zip(s.tolist(), ids[at].tolist(), strict=True)] + [(-v, i) for v, i in self.found[q]])
            self.found[q] = [(-v, i) for v, i in both[: self.k]]
            if len(both) >= self.k:
                self.least[q] = self.found[q][-1][0]


def beyond(score: int) -> bytes:
    """A key in the order of integers, for those that a long can't tell; empty for others."""
    if _LEAST < score < _MOST:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    key = b"\1" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else b"\0" + bytes(255 - b for b in key[1:])


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, are left out. An empty vector stays: its products are 0. Other columns are ignored."""
    whole = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(whole)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all rows but its own.

    rows and queries: (vec_id, v array of double or long), without nulls, each component counting as floor(scale * x);
    missing components count as 0. Products are exact integers of any size and so is their order; ties go to the
    smaller vec_id. A score beyond the range of a long is given as the range's end. A query has all rows if there are
    fewer than k; without rows or queries there is no result. Rows with the id of the query are its own, however many.
    Queries that repeat an id count once (the first by vector); repeated candidate rows each count. Very long vectors
    and other columns than those named need no care: the first take more blocks, the second are ignored.

    Candidates and queries are dealt to groups by hash; every pair of a candidate group and a query group is a cell,
    in which the queries are held and the candidates stream past in blocks. A task takes one cell after the other, so
    the number of tasks follows the session's, not the number of cells. A cell returns k rows a query.
    """
    spark = rows.sparkSession
    n, q, parts = rows.count(), queries.count(), shuffle_parts(rows.sparkSession)
    query_groups = -(-max(q, 1) // QUERY_ROWS)
    groups = max(-(-max(n, 1) // GROUP_ROWS), min(-(-CELLS * parts // query_groups), -(-max(n, 1) // BLOCK)))
    cells = groups * query_groups
    c = rows.select("vec_id", "v").withColumn("g", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    p = queries.select("vec_id", "v").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(query_groups))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = lambda a, b: (F.col(a) * query_groups + F.col(b)).cast("long").alias("cell")
    both = c.select(cell("g", "o"), F.lit(1).alias("kind"), "vec_id", "v").unionByName(p.select(cell("o", "g"), F.lit(0).alias("kind"), "vec_id", "v"))
    both = both.repartition(min(cells, CELLS * parts), "cell").sortWithinPartitions("cell", "kind", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        held: list[tuple[Postings, Top]] = []
        seen: set[int] = set()
        waiting, now, last = 0, None, None  # values in vectors; the cell; kind of the last row

        def flush() -> None:
            nonlocal waiting
            if not ids:
                return
            own, at = np.array(ids, np.int64), np.r_[0, np.cumsum([len(v) for v in vectors])].astype(np.int64)
            postings = Postings(whole_numbers(np.concatenate(vectors), scale), at)
            ids.clear()
            vectors.clear()
            waiting = 0
            if not last:
                held.append((postings, Top(own, k)))
                return
            for chunk, top in held:
                top.add(postings.scores(chunk), own)

        def finish() -> Iterator[pa.RecordBatch]:
            flush()
            rows_ = [(query, i, min(max(v, _LEAST), _MOST), beyond(v)) for _, top in held for query, found in zip(top.queries.tolist(), top.found, strict=True) for v, i in found]
            held.clear()
            seen.clear()
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "beyond"])

        for b in batches:
            values = b.column("v")
            flat, at = np.asarray(values.flatten()), np.r_[0, np.cumsum(np.asarray(values.value_lengths()))].astype(np.int64)
            for r, (c_, kind, vec_id) in enumerate(zip(b.column("cell").to_pylist(), b.column("kind").to_pylist(), b.column("vec_id").to_pylist(), strict=True)):
                if c_ != now:
                    yield from finish()
                    now, last = c_, kind
                elif kind != last or len(ids) >= (BLOCK if kind else CHUNK) or waiting > 1 << 21:
                    flush()
                    last = kind
                if not kind:
                    if vec_id in seen:
                        continue
                    seen.add(vec_id)
                elif not held:
                    continue
                v = flat[at[r] : at[r + 1]]
                ids.append(vec_id)
                vectors.append(v)
                waiting += len(v)
        yield from finish()

    found = both.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    # At most k rows for each query and candidate group reach the window.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
