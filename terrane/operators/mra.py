"""Multi-resolution trees: their parameters, the partition of points into knots, and conditioning on ancestors."""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import in_one_task


def _power_of_two(x: float) -> int:
    """The smallest power of two that isn't below x, 1 at least."""
    return 1 << max(0, math.ceil(math.log2(x))) if x > 1 else 1


@dataclass(frozen=True)
class Tree:
    """M levels below the root, r knots in a node of each of the M + 1 levels, J children of a node of each of M levels."""

    M: int
    r: tuple[int, ...]
    J: tuple[int, ...]


def choose(n: int, m: int) -> Tree:
    """A binary tree for n points with conditioning sets of about m.

    It is as deep as the least k with 2**k / k > n / m, but has a knot for each level in m. The m knots of a path are
    spread evenly, the odd ones low down. If m ends the tree early, the last nodes have as many children as the points
    that are left need.
    """
    wanted = next(k for k in itertools.count(1) if m * 2**k > n * k)
    depth = max(1, min(wanted, m - 1))
    children = [2] * depth
    if m - 1 < wanted:
        children[-1] = _power_of_two((n - 2**depth + 1) / 2 ** (depth - 1))
    tree = Tree(depth, tuple(max(1, (m + k) // (depth + 1)) for k in range(depth + 1)), tuple(children))
    if sum(r * math.prod(children[:k]) for k, r in enumerate(tree.r)) < n:
        raise ValueError("no tree fits n and m")
    return tree


def parameters(n: int, m: int, r: Sequence[int] | None = None, J: Sequence[int] | int | None = None, M: int | None = None) -> Tree:  # noqa: N803
    """The tree for what is given. r = (0, k): independent blocks of k; r = (k, 1): k common knots (low rank); M alone: knots
    spread evenly; nothing: choose(). Children are rounded up to powers of two and single values stand for all levels."""
    r = [r] if isinstance(r, int) else list(r) if r is not None else None
    given = [J] if isinstance(J, int) else list(J) if J is not None else None
    children = [_power_of_two(j) for j in given] if given else None
    if M is None and r is None:
        return choose(n, m)
    if M is None:
        if children is None:
            if len(r) == 2 and r[0] == 0:
                children = [_power_of_two(n / r[1])]
            elif len(r) == 2 and r[1] == 1:
                children = [_power_of_two(n - r[0])]
            else:
                children = [2]
        if len(r) > 1:
            M = len(r) - 1  # noqa: N806
        elif len(children) > 1:
            M = len(children)  # noqa: N806
        else:
            M = math.floor((math.log(n / r[0]) * (children[0] - 1) + 1) / math.log(children[0])) - 1  # noqa: N806
    elif r is None:
        r = [math.ceil(m / (M + 1))]
        if children is None:
            last = _power_of_two((n - r[0] * (2**M - 1)) / r[0]) / 2 ** (M - 1)
            children = [2] * (M - 1) + [max(1, int(last))]
    else:
        if m > 0:
            warnings.warn("M and r are given: m is overridden", stacklevel=2)
        children = children or [2]
    return Tree(M, tuple(r * (M + 1) if len(r) == 1 else r), tuple(children * M if len(children) == 1 else children))


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each row among the rows of its group (numbered from 0), in the given order."""
    by = np.argsort(group, kind="stable")
    size = np.bincount(group)
    place = np.empty(len(group), np.int64)
    place[by] = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    return place


def upper_half(x: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Which rows are in the upper half of their region (numbered from 0) by x; of n rows n // 2 are.

    All regions are cut at once, by rank. Of the rows with the value at which the cut falls, the first go to the side
    that has fewer other rows until both are even, and of the rest the first half goes up.
    """
    by = np.lexsort((-x, region))
    size = np.bincount(region)
    first = (np.cumsum(size) - size)[region[by]]
    fresh = np.r_[True, (region[by][1:] != region[by][:-1]) | (x[by][1:] != x[by][:-1])][: len(by)]
    run = np.cumsum(fresh) - 1
    opens, length = np.flatnonzero(fresh), np.bincount(run)
    half = size[region[by]] // 2
    cut = run[first + half]
    above, level = opens[cut] - first, length[cut]
    below = size[region[by]] - above - level
    tied = np.arange(len(by)) - first - above - np.maximum(above - below, 0)
    up = np.empty(len(by), bool)
    up[by] = (run < cut) | ((run == cut) & (tied >= 0) & (tied < half - above))
    return up


def split_regions(x: np.ndarray, region: np.ndarray, k: int, first_dim: int) -> np.ndarray:
    """The part (0 to k - 1, k a power of two) of its region each row is in, by medians of one dimension after the other."""
    part = np.zeros(len(x), np.int64)
    for level in range((k - 1).bit_length()):
        _, own = np.unique(region * np.int64(k) + part, return_inverse=True)
        part = 2 * part + ~upper_half(x[:, (first_dim + level) % x.shape[1]], own)
    return part


def knots(x: np.ndarray, tree: Tree) -> dict[str, np.ndarray]:
    """The knots of each node: rows of x in their order. A node's id is its parent's with _ and its number; the root is r.

    A node's first rows are its knots and the rest is dealt to its children, for all nodes of a depth together.
    """
    out: dict[str, np.ndarray] = {}
    names, region, live = ["r"], np.zeros(len(x), np.int64), np.arange(len(x))
    for depth in range(tree.M + 1):
        place = _places(region)
        taken = place < (tree.r[depth] if depth < tree.M else len(x))
        out |= {names[k]: live[taken & (region == k)] for k in np.unique(region[taken])}
        region, place, live = region[~taken], place[~taken], live[~taken]
        if not len(live):
            break
        # Regions with fewer rows than children: each row is a child of its own.
        many = np.bincount(region)[region] >= tree.J[depth]
        child = place - tree.r[depth]
        child[many] = split_regions(x[live[many]], np.unique(region[many], return_inverse=True)[1], tree.J[depth], depth % 2 + 1)
        (up, own), region = np.unique([region, child], axis=1, return_inverse=True)
        names = [f"{names[a]}_{b}" for a, b in zip(up, own, strict=True)]
    return out


def knot_table(ordered: DataFrame, tree: Tree) -> DataFrame:
    """node_id, depth, place, pos: the knots of each node in their order. Medians of whole regions: one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos", ignore_index=True)
        found = knots(np.stack(p["coords"].to_numpy()), tree)
        rows = [(node, node.count("_"), i, int(r)) for node, own in found.items() for i, r in enumerate(own)]
        return pd.DataFrame(rows, columns=["node_id", "depth", "place", "pos"]).astype({"depth": "int32", "place": "int32"})

    return in_one_task(ordered.select("pos", "coords"), run, "node_id string, depth int, place int, pos long")


def parent(node):
    """The id of a node's parent; null for a root."""
    return F.when(F.instr(node, "_") > 0, F.regexp_replace(node, "_[^_]*$", ""))


def depth(node):
    return F.size(F.split(node, "_")) - 1


def ancestor_neighbors(table: DataFrame) -> DataFrame:
    """pos, slot, nbr_pos: each knot, the earlier knots of its node, and all knots of the nodes above it; nearest levels and
    latest knots first. An equi-join on the ids of ancestors."""
    parts = F.split("node_id", "_")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    mine = table.select("pos", "place", F.col("depth").alias("own"), F.explode(above).alias("node_id"))
    other = table.select("node_id", F.col("depth").alias("d"), F.col("place").alias("p"), F.col("pos").alias("nbr_pos"))
    near = mine.join(other, "node_id").where((F.col("d") < F.col("own")) | (F.col("p") <= F.col("place")))
    # A set is a path of the tree: bounded by the sum of its nodes' knots.
    sets = near.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("d", "p", "nbr_pos")), asc=False).alias("s"))
    return sets.select("pos", F.posexplode("s").alias("slot", "e")).select("pos", "slot", F.col("e.nbr_pos").alias("nbr_pos"))
