"""Orderings of points: each returns the input rows with `pos`, their place from 0."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import distance
from ..sources.points import lonlat_xyz
from ..sources.storage import in_one_task, numbered

#: Points that one block of the exact max-min ordering holds.
BLOCK = 256


def by_coordinate(points: DataFrame, which: Sequence[int] | None = None) -> DataFrame:
    """Ascending by the sum of the chosen coordinates (from 0), all if none is named; ties by loc_id."""
    c = F.col("coords") if which is None else F.array(*[F.col("coords")[i] for i in which])
    return numbered(points, F.aggregate(c, F.lit(0.0), lambda s, x: s + x), F.col("loc_id"))


def _distance_to(points: DataFrame, loc0: Sequence[float], lonlat: bool):
    c = lonlat_xyz(F.col("coords")) if lonlat else F.col("coords")
    return distance(c, F.array(*[F.lit(float(x)) for x in loc0]))


def by_distance(points: DataFrame, loc0: Sequence[float], lonlat: bool = False, outside_in: bool = False) -> DataFrame:
    """Ascending by distance to loc0, ties by loc_id; outside_in: the reverse. With lonlat both are longitudes and
    latitudes in degrees (loc0 may be a point of the unit sphere instead) and distances are those of the sphere's chords."""
    loc0 = list(loc0)
    first = points.select(F.size("coords").alias("d")).first()
    d = first["d"] if first else len(loc0)
    if lonlat and len(loc0) == d:
        row = points.sparkSession.range(1).select(lonlat_xyz(F.array(*[F.lit(float(x)) for x in loc0])).alias("p")).first()
        loc0 = row["p"]
    if len(loc0) != (d + 1 if lonlat else d):
        raise ValueError("loc0 has another number of coordinates than the points")
    dist = _distance_to(points, loc0, lonlat)
    return numbered(points, -dist, -F.col("loc_id")) if outside_in else numbered(points, dist, F.col("loc_id"))


def center(points: DataFrame, lonlat: bool = False) -> list[float]:
    """The mean of each coordinate, of points of the unit sphere with lonlat. Sums are exact: on a regular grid the last bit of
    the mean decides between places at one distance, and it mustn't hang on the order of rows."""
    c = lonlat_xyz(F.col("coords")) if lonlat else F.col("coords")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, []
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("c").flatten()).reshape(b.num_rows, -1)
                n, parts = n + b.num_rows, [expansion([*own, *x[:, i].tolist()]) for i, own in enumerate(parts or [[]] * x.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([parts], pa.list_(pa.list_(pa.float64())))], ["n", "parts"])

    rows = [r for r in points.select(c.alias("c")).mapInArrow(sums, "n long, parts array<array<double>>").collect() if r["n"]]
    n = sum(r["n"] for r in rows)  # a few numbers a task and dimension
    return [math.fsum(v for r in rows for v in r["parts"][i]) / n for i in range(len(rows[0]["parts"]) if rows else 0)]


def expansion(values: list[float]) -> list[float]:
    """A few doubles whose exact sum is that of the values."""
    out: list[float] = []
    while (rest := math.fsum([*values, *(-s for s in out)])) and math.isfinite(rest):
        out.append(rest)
    return out if math.isfinite(rest) else [rest]


def middle_out(points: DataFrame, lonlat: bool = False, outside_in: bool = False) -> DataFrame:
    """By distance to the mean of all points."""
    c = lonlat_xyz(F.col("coords")) if lonlat else F.col("coords")
    dist = distance(c, F.array(*[F.lit(x) for x in center(points, lonlat)]))
    return numbered(points, -dist, -F.col("loc_id")) if outside_in else numbered(points, dist, F.col("loc_id"))


def outside_in(points: DataFrame, lonlat: bool = False) -> DataFrame:
    """The reverse of middle_out, ties too."""
    return middle_out(points, lonlat, outside_in=True)


def as_given(points: DataFrame) -> DataFrame:
    """By loc_id."""
    return numbered(points, F.col("loc_id"))


def maxmin_places(x: np.ndarray, first: int | None = None) -> np.ndarray:
    """The exact max-min ordering of the rows of x: first the row nearest the mean, then always the row farthest from
    those taken, ties to the smaller row. With `first` the first so many rows are all taken before the others; the row
    nearest the mean is then one of theirs.

    Rows are cut into blocks along the widest dimension again and again. A new point changes only blocks whose box is
    nearer to it than the block's largest distance, so a step looks at all boxes but at few points.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    turns = [rows for rows in np.split(np.arange(n), [n if first is None else first]) if len(rows)]
    blocks, turn_of, todo = [], [], list(enumerate(turns))
    while todo:
        turn, rows = todo.pop()
        if len(rows) <= BLOCK:
            blocks.append(np.sort(rows))
            turn_of.append(turn)
            continue
        dim = int(np.argmax(np.ptp(x[rows], axis=0)))
        order = rows[np.argsort(x[rows, dim], kind="stable")]
        todo += [(turn, order[: len(order) // 2]), (turn, order[len(order) // 2 :])]
    width = max(map(len, blocks))
    row = np.full((len(blocks), width), n)
    for i, b in enumerate(blocks):
        row[i, : len(b)] = b
    real = row < n
    place = x[np.minimum(row, n - 1)]
    low = np.where(real[..., None], place, np.inf).min(1)
    high = np.where(real[..., None], place, -np.inf).max(1)
    far = np.where(real, np.inf, -1.0)
    best, at = far.max(1), far.argmax(1)
    mine = x[turns[0]]
    pick = int(np.argmin(((mine - mine.mean(0)) ** 2).sum(1)))
    out = np.empty(n, np.int64)
    block_of, slot_of = np.empty(n, np.int64), np.empty(n, np.int64)
    block_of[row[real]], slot_of[row[real]] = np.nonzero(real)
    now = [np.flatnonzero(np.array(turn_of) == turn) for turn in range(len(turns))]
    for k in range(n):
        out[k] = pick
        p = x[pick]
        far[block_of[pick], slot_of[pick]] = -1.0
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        touched = np.flatnonzero((gap * gap).sum(1) < best)
        touched = np.union1d(touched, block_of[pick])
        d = ((place[touched] - p) ** 2).sum(-1)
        far[touched] = np.minimum(far[touched], d)
        best[touched], at[touched] = far[touched].max(1), far[touched].argmax(1)
        if k + 1 < n:
            open_ = now[0] if k + 1 < len(turns[0]) else now[-1]
            ties = open_[best[open_] == best[open_].max()]
            pick = int(row[ties, at[ties]].min())
    return out


def maxmin(points: DataFrame) -> DataFrame:
    """The exact max-min ordering, ties to the smaller loc_id. Sequential by nature: it runs in one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("loc_id", ignore_index=True)
        places = maxmin_places(np.stack(p["coords"].to_numpy()))
        return pd.DataFrame({"loc_id": p["loc_id"].to_numpy()[places], "pos": np.arange(len(p))})

    return points.join(in_one_task(points.select("loc_id", "coords"), run, "loc_id long, pos long"), "loc_id")


def maxmin_obs_pred(points: DataFrame) -> DataFrame:
    """Observed points in max-min order, then always the predicted point farthest from all points before it, observed and
    predicted; ties to the smaller loc_id. One task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["is_obs", "loc_id"], ascending=[False, True], ignore_index=True)
        places = maxmin_places(np.stack(p["coords"].to_numpy()), int(p["is_obs"].sum()))
        return pd.DataFrame({"loc_id": p["loc_id"].to_numpy()[places], "pos": np.arange(len(p))})

    return points.join(in_one_task(points.select("loc_id", "coords", "is_obs"), run, "loc_id long, pos long"), "loc_id")


def observed_first(points: DataFrame, key) -> DataFrame:
    """Observed points by key and loc_id, then predicted ones by the same."""
    return numbered(points, (~F.col("is_obs")).cast("int"), key, F.col("loc_id"))


def rotated(ordered: DataFrame, cut: int = 9) -> DataFrame:
    """The second to the min(n, cut)-th place go to the end; others move up."""
    n = ordered.count()
    k = min(n, cut)
    p = F.col("pos")
    return ordered.withColumn("pos", F.when(p == 0, p).when(p < k, p + (n - k)).otherwise(p - (k - 1)))
