"""Nearest-neighbour joins by grid blocks with growing cells, or by blocks of pairs in many dimensions, and conditioning sets
made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Queries that one group of the join holds at most, and candidates that a cell of the first round holds, about.
QUERIES, CANDIDATES = 2048, 128

#: Coordinates from which the grid prunes nothing, so that all pairs are looked at, and rows of a side of a block of pairs.
MANY, SIDE = 8, 32768

_OUT = "query long, slot int, nbr long, dist double, done boolean"


def _solver(k: int, low: list[float], span: list[float], size: float, last: bool, dense: bool):
    """What a group of the join does: exact distances of its queries to its candidates, and which queries are done."""

    def solve(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"query": [], "slot": [], "nbr": [], "dist": [], "done": []})
        b = b.sort_values("nbr", ignore_index=True)
        ids = b["nbr"].to_numpy(np.int64)
        x = np.stack(a["coords"].to_numpy())
        y = np.stack(b["place"].to_numpy()) if len(b) else np.zeros((0, x.shape[1]))
        before = a["before"].astype("float64").fillna(np.inf).to_numpy()
        own = a["query"].to_numpy(np.int64)
        border = np.full(len(a), np.inf)
        for j in range(len(low)):
            c = key[j]
            for edge, sign in ((low[j] + (c - 1) * size, 1), (low[j] + (c + 2) * size, -1)):
                beyond = edge > low[j] if sign > 0 else edge <= low[j] + span[j]
                if beyond and not last:
                    border = np.minimum(border, sign * (x[:, j] - edge))
        out = []
        step = max(1, (1 << 22) // max(len(ids), 1) // max(x.shape[1], 1))
        for s in range(0, len(a), step):
            d = np.sqrt(((x[s : s + step, None] - y[None]) ** 2).sum(-1))
            d[(ids[None] >= before[s : s + step, None]) | (ids[None] == own[s : s + step, None])] = np.inf
            # A partition for the k-th distance; only what isn't beyond it is put in order.
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            r, c = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            dist = d[r, c]
            order = np.lexsort((c, dist, r))
            r, c, dist = r[order], c[order], dist[order]
            slot = np.arange(len(r)) - np.searchsorted(r, np.arange(len(d)))[r]
            ok = (kth <= border[s : s + step]) | np.isinf(border[s : s + step])
            if dense:  # all candidates before a query are in sight
                ok |= np.isfinite(d).sum(1) >= before[s : s + step]
            keep = (slot < k) & ok[r]
            r, c, dist, slot = r[keep], c[keep], dist[keep], slot[keep]
            out.append(pd.DataFrame({"query": own[s + r], "slot": (slot + 1).astype(np.int32), "nbr": ids[c], "dist": dist, "done": True}))
            out.append(pd.DataFrame({"query": own[s : s + step][~ok], "slot": np.int32(0), "nbr": np.int64(-1), "dist": 0.0, "done": False}))
        return pd.concat(out)

    return solve


def nearest_rows(x: np.ndarray, own: np.ndarray, before: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of y for each row of x, ties to the smaller id: places in x, ids and distances, the nearest first.
    Those with ids >= before, with ids = own or at no finite distance don't count.

    Matrix products give lower and upper bounds of squared distances, in tiles; a distance is computed by differences where
    its lower bound isn't beyond the k-th distance so far.
    """
    d = x.shape[1]
    slack = 8 * (d + 8) * np.finfo(float).eps  # of a bound, as a share of |x|^2 + |y|^2
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(x), 1024):
        xa, first = x[a : a + 1024], before[a : a + 1024]
        row, nbr, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth = np.full(len(xa), np.inf)
        for b in range(0, len(y), 4096):
            yb, at = y[b : b + 4096], ids[b : b + 4096]
            if not (at.min() < first).any():
                continue
            with np.errstate(all="ignore"):
                g = xa @ yb.T
                g *= -2
                low = g + (1 - slack) * yy[b : b + 4096]
            low[at[None] == own[a : a + 1024, None]] = np.inf
            if (at.max() >= first).any():
                low[at[None] >= first[:, None]] = np.inf
            np.copyto(low, np.inf, where=np.isnan(low))
            with np.errstate(all="ignore"):
                most = kth * kth * (1 + slack)
                new = np.flatnonzero(np.isinf(kth))
                if len(new) and low.shape[1] >= k:
                    high = low[new] + 2 * slack * yy[b : b + 4096]
                    high[~np.isfinite(high)] = np.inf
                    most[new] = np.maximum(np.partition(high, k - 1, axis=1)[:, k - 1] + (1 + slack) * xx[a : a + 1024][new], 0) * (1 + slack)
                r, c = np.nonzero((low <= (most - (1 - slack) * xx[a : a + 1024])[:, None]) & (low < np.inf))
            if not len(r):
                continue
            far = np.concatenate([np.sqrt(((xa[r[s : s + 65536]] - yb[c[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(r), 65536)])
            ok = np.isfinite(far)
            row, nbr, dist = np.r_[row, r[ok]], np.r_[nbr, at[c[ok]]], np.r_[dist, far[ok]]
            order = np.lexsort((nbr, dist, row))
            row, nbr, dist = row[order], nbr[order], dist[order]
            slot = np.arange(len(row)) - np.searchsorted(row, np.arange(len(xa)))[row]
            keep = slot < k
            kth[row[slot == k - 1]] = dist[slot == k - 1]
            row, nbr, dist = row[keep], nbr[keep], dist[keep]
        out.append((a + row, nbr, dist))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(o) for o in zip(*out, strict=True))


def _array(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _all_pairs(queries: DataFrame, candidates: DataFrame, k: int, dense: bool, n: int, d: int) -> DataFrame:
    """nearest by all pairs: blocks of queries meet blocks of candidates, a task holds one of each, and the k nearest of
    each block are merged. Work is quadratic, memory isn't: a row moves once for each block of the other side. dense: blocks
    are ranges of ids, and those of candidates after all queries of a block aren't met."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    side = max(1, -(-n // SIDE), min(int(np.ceil((4 * cores) ** 0.5)), n // 1024))

    def block(c: str):
        if dense:
            return F.least(F.floor(F.col(c) * F.lit(side) / F.lit(n)), F.lit(side - 1)).cast("int")
        return F.pmod(F.xxhash64(c), F.lit(side)).cast("int")

    # Queries of a dense numbering meet the candidates before them only.
    others = F.sequence(F.lit(0), F.least(block("before"), F.lit(side - 1)) if dense else F.lit(side - 1))
    q = queries.select(block("before" if dense else "query").alias("i"), F.explode(others).alias("j"), "query", "coords", "before")
    meet = F.sequence(F.col("j"), F.lit(side - 1)) if dense else F.sequence(F.lit(0), F.lit(side - 1))
    c = candidates.select(block("nbr").alias("j"), "nbr", "coords").select(F.explode(meet).alias("i"), "j", "nbr", F.col("coords").alias("place"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        b = b.sort_by("nbr")
        own, ids = a["query"].to_numpy(), b["nbr"].to_numpy()
        before = a["before"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        row, nbr, dist = nearest_rows(_array(a["coords"], d), own, before, _array(b["place"], d), ids, k)
        return pa.table({"query": own[row], "nbr": nbr, "dist": dist})

    found = q.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInArrow(solve, "query long, nbr long, dist double")
    slot = F.row_number().over(Window.partitionBy("query").orderBy("dist", "nbr"))
    return found.withColumn("slot", slot).where(F.col("slot") <= k).select("query", "slot", "nbr", "dist")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, dense: bool = False) -> DataFrame:
    """query, slot (from 1), nbr, dist: the k nearest candidates of each query, ties to the smaller nbr.

    queries: (query, coords, before): candidates with nbr >= before, and the one with nbr = query, don't count; a null
    before allows all. candidates: (nbr, coords). A query with fewer candidates gets them all. dense: the candidates are
    numbered 0, 1, 2, ..., so before tells how many there are for a query.

    The plane of the first two coordinates is cut into cells. A query sees the 3 x 3 cells around its own; it is done if
    its k-th distance is not beyond the border of those (or nothing lies beyond). The others get cells four times as
    large, so all work is an equi-join on cells. Crowded cells are dealt to several groups by query. From MANY coordinates
    on all pairs are looked at.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "query long, slot int, nbr long, dist double")
    box = candidates.agg(F.count("*").alias("n"), F.max(F.size("coords")).alias("d"), *[f(F.try_element_at("coords", F.lit(i))).alias(f"{s}{i}") for i in (1, 2) for s, f in (("a", F.min), ("b", F.max))]).first()
    n = box["n"]
    if n and box["d"] >= MANY:
        return _all_pairs(queries, candidates, k, dense, n, box["d"])
    dims = [i for i in (1, 2) if box[f"a{i}"] is not None]
    low = [box[f"a{i}"] for i in dims]
    span = [max(box[f"b{i}"] - box[f"a{i}"], 1e-12) for i in dims]
    wide = [s for s in span if s > 1e-9 * max(span, default=1)] or [1.0]
    cell = (np.prod(wide) * max(CANDIDATES, 2 * k) / max(n, 1)) ** (1 / len(wide))
    left, found = queries, []
    while True:
        size = float(cell)
        last = all(s <= size for s in span)
        at = [F.floor((F.col("coords")[i - 1] - F.lit(low[j])) / F.lit(size)).cast("int") for j, i in enumerate(dims)]
        # Queries may lie outside the candidates' box.
        q = left.withColumns({f"c{j}": F.greatest(F.lit(-1), F.least(F.lit(int(span[j] // size) + 1), c)) for j, c in enumerate(at)})
        cells = [f"c{j}" for j in range(len(dims))]
        crowd = q.groupBy(*cells).agg(F.count("*").alias("_q"), F.max(F.coalesce("before", F.lit(1 << 62))).alias("_most"))
        groups = F.ceil(F.col("_q") / F.lit(QUERIES)).cast("int")
        q = q.join(crowd.drop("_most"), cells).withColumn("salt", F.pmod(F.xxhash64("query"), groups.cast("long")).cast("int")).select(*cells, "salt", "query", "coords", "before")
        halo = candidates.select("nbr", "coords").withColumns({f"h{j}": c for j, c in enumerate(at)})
        for j in range(len(dims)):
            halo = halo.withColumn(f"c{j}", F.explode(F.array(*[F.col(f"h{j}") + s for s in (-1, 0, 1)])))
        halo = halo.join(crowd, cells).where("nbr < _most").withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))).select(*[F.col(c).alias(f"of_{c}") for c in [*cells, "salt"]], "nbr", F.col("coords").alias("place"))

        key = [*cells, "salt"]
        got = materialise(q.groupBy(*key).cogroup(halo.groupBy(*[f"of_{c}" for c in key])).applyInPandas(_solver(k, low, span, size, last, dense), _OUT))
        found.append(got.where("done").select("query", "slot", "nbr", "dist"))
        if last:
            break
        waiting = got.where("not done").select("query")
        if not waiting.limit(1).count():
            break
        left = materialise(left.join(waiting, "query"))
        cell *= 4
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _with_self(found: DataFrame, ordered: DataFrame) -> DataFrame:
    rows = found.select(F.col("query").alias("pos"), "slot", F.col("nbr").alias("nbr_pos"))
    own = ordered.select("pos", F.lit(0).alias("slot"), F.col("pos").alias("nbr_pos"))
    return own.unionByName(rows)


def ordered_neighbors(ordered: DataFrame, m: int) -> DataFrame:
    """pos, slot, nbr_pos: each point itself (slot 0) and its at most m nearest earlier points, nearest first."""
    q = ordered.select(F.col("pos").alias("query"), "coords", F.col("pos").alias("before"))
    return _with_self(nearest(q, ordered.select(F.col("pos").alias("nbr"), "coords"), m, dense=True), ordered)


def line_neighbors(ordered: DataFrame, m: int) -> DataFrame:
    """ordered_neighbors of points in ascending order of one coordinate: the m before each, the later of equals first. A
    projection: no rows move."""
    lags = F.sequence(F.lit(0), F.least(F.col("pos"), F.lit(m)).cast("int"))
    return ordered.select("pos", F.explode(lags).alias("slot")).select("pos", "slot", (F.col("pos") - F.col("slot")).alias("nbr_pos"))


def plain_neighbors(points: DataFrame, k: int, key: str = "loc_id") -> DataFrame:
    """query, slot, nbr, dist: the k nearest other points."""
    q = points.select(F.col(key).alias("query"), "coords", F.lit(None).cast("long").alias("before"))
    return nearest(q, points.select(F.col(key).alias("nbr"), "coords"), k)


def query_neighbors(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """query, slot, nbr, dist: the k nearest points of each query location (query, coords). Ids of the two tables don't
    refer to each other."""
    q = queries.select((-F.col("query") - 1).alias("query"), "coords", F.lit(None).cast("long").alias("before"))
    out = nearest(q, points.select(F.col("loc_id").alias("nbr"), "coords"), k)
    return out.withColumn("query", -F.col("query") - 1)


def independent_predictions(ordered: DataFrame, conditioning: DataFrame, m: int) -> DataFrame:
    """The conditioning sets with those of predicted points replaced by their m nearest observed points, in descending
    order of pos."""
    pred = ordered.where(~F.col("is_obs"))
    q = pred.select(F.col("pos").alias("query"), "coords", F.lit(None).cast("long").alias("before"))
    near = nearest(q, ordered.where("is_obs").select(F.col("pos").alias("nbr"), "coords"), m)
    sets = near.groupBy("query").agg(F.sort_array(F.collect_list("nbr"), asc=False).alias("s"))  # m ids a point
    rows = sets.select(F.col("query").alias("pos"), F.posexplode("s").alias("i", "nbr_pos")).select("pos", (F.col("i") + 1).alias("slot"), "nbr_pos")
    own = pred.select("pos", F.lit(0).alias("slot"), F.col("pos").alias("nbr_pos"))
    rest = conditioning.join(pred.select("pos"), "pos", "left_anti")
    return rest.unionByName(own).unionByName(rows)


def first_neighbors(ordered: DataFrame, m: int) -> DataFrame:
    """pos, slot, nbr_pos: each point and those of the first m that come before it, latest first."""
    slots = F.expr(f"sequence(0, least(cast(pos as int), {m}))")
    back = F.when(F.col("slot") == 0, F.col("pos")).otherwise(F.least(F.col("pos"), F.lit(m).cast("long")) - F.col("slot"))
    return ordered.select("pos", F.explode(slots).alias("slot")).withColumn("nbr_pos", back)


def no_neighbors(ordered: DataFrame) -> DataFrame:
    """pos, slot, nbr_pos: each point by itself."""
    return ordered.select("pos", F.lit(0).alias("slot"), F.col("pos").alias("nbr_pos"))


def check_m(m: int | None, n: int, has_r: bool = False) -> int:
    """m, at most n - 1. Raises without m unless knots are given."""
    import warnings

    if m is None or m < 0:
        if not has_r:
            raise ValueError("neither m nor the knots r of a tree are given")
        return -1
    if m > n:
        warnings.warn("m is larger than n: n - 1 is taken", stacklevel=2)
    return min(m, max(n - 1, 0))
