"""Similarity self-join of documents by the Jaccard index of their word n-grams, by chosen paths.

1. Sets. Each document becomes its set of n-gram hashes; documents with equal sets (by 128 bits) are one node with a
   count.
2. Paths. In each run a set chooses each of its members with probability 1 / (least * size), by a hash that all sets
   share. Sets that are similar enough share a path with a probability that does not depend on their size; the number
   of runs follows from the target recall.
3. Recursion. Sets with a common path are a bucket. A bucket with more than SMALL sets is split: each of its sets chooses
   again below the path, REPEATS times, and so on down. A bucket whose sets stand in crowded buckets with most of their
   other paths too, or that is not half the size of the one above it, holds sets that paths don't part: it is compared
   in blocks, like small ones.
4. Buckets. Sketches of 128 bytes tell pairs that may be similar; only a spanning forest of them leaves a bucket, so its
   output is linear in its size.
5. Clusters. Connected sets are compared exactly, in blocks, once for each pair. What leaves is each node's number of
   links and a spanning forest of the exact links, whose components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialise, mix, prefix, shuffle_parts, signed, slices, text_bytes
from .components import components

WORDS, LEAST = 5, 0.8
SMALL, BLOCK = 256, 512
RECALL = 0.999
#: Choices below a path, each independent of the others, and levels of paths at most: what is crowded on the last one is
#: compared in blocks.
REPEATS, LEVELS = 2, 12
#: Share of a set's first paths in crowded buckets from which on splitting gives no fewer crowded buckets: below a crowded
#: path a set has REPEATS / 0.8 choices, of which that share is crowded again.
SHARED = 0.4
#: Bins of a sketch, and the share of equal ones that lets a pair go to the exact comparison. With 64 bins a pair of
#: similarity 0.8 stays below 0.55 once in some 100,000 pairs and path.
BINS, MAYBE = 64, 0.55

_U = np.uint64


def runs_for(recall: float) -> int:
    """Runs after which a pair that is just similar enough has met with this probability, however deep its buckets are split.

    At the least similarity the shared choices of a run are about Poisson with mean 1, and those below a shared path with
    mean REPEATS; so a shared path leads to one at any depth with a probability of at least g = 1 - exp(-REPEATS * g).
    """
    g = 1.0
    for _ in range(200):
        g = 1 - math.exp(-REPEATS * g)
    return max(1, math.ceil(math.log(1 - recall) / -g))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, end to end, and first[d]:first[d + 1] as the range of text d.

    A text of fewer than k words, but one at least, has one n-gram of all its words.
    """
    w = Words(*text_bytes(texts))
    word = w.hashes()
    h, at = w.grams(k, word)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        sums, inverse = prefix(word)
        a, z = w.first[short], w.first[short + 1]
        h = np.r_[h, mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(_U))]
        doc = np.r_[doc, short]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int64)


def set_digest(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    size = np.diff(first).astype(_U)
    out = []
    for salt in (1, 2):
        sums = np.r_[_U(0), np.cumsum(mix(h + _U(salt)), dtype=_U)]
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + size * _U(salt * 2 + 1)))
    return out[0], out[1]


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BINS 16-bit values of each set: of the least member of each bin of hashes; 0 for a bin without members."""
    out = np.zeros((len(first) - 1, BINS), np.uint16)
    if len(h):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        part = (h >> _U(58)).astype(np.int64)
        least = np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]
        out[doc[least], part[least]] = (h[least] & _U(0xFFFF)).astype(np.uint16) | 1
    return out


def _limit(size: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(2.0**64 / (least * np.maximum(size, 1)), 2.0**64 - 4096).astype(_U)


def paths(h: np.ndarray, first: np.ndarray, runs: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, path): the members that the sets choose in each run, as paths of the first level."""
    size = np.diff(first)
    limit = _limit(size, least)
    doc = np.repeat(np.arange(len(size)), size)
    of, path = [], []
    for r in range(runs):
        odd = mix(np.array([r * 2 + 1], _U))[0] | _U(1)
        at = np.flatnonzero(mix(h * odd) <= limit[doc])
        of.append(doc[at])
        path.append(mix(h[at] ^ mix(np.array([r + 1000], _U))[0]))
    return np.concatenate(of), np.concatenate(path)


def paths_below(h: np.ndarray, above: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in above, path) of the members that one set chooses below each of its paths."""
    limit = _limit(np.array([len(h)]), least)[0]
    of, path = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    step = max(1, (1 << 20) // max(len(h), 1))
    for low in range(0, len(above), step):
        for r in range(REPEATS):
            top = mix(above[low : low + step] + mix(np.array([r + 1], _U)))
            i, member = np.nonzero(mix(h[None, :] ^ top[:, None]) <= limit)
            of.append(i + low)
            path.append(mix(h[member] + top[i] * _U(3)))
    return np.concatenate(of), np.concatenate(path)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(doc, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)), pa.array(signed(values[order])))


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row of its component."""
    n = len(linked)
    label = np.arange(n)
    some = np.flatnonzero(linked.any(1))
    if not len(some):
        return label
    sub = linked[np.ix_(some, some)]
    own = np.arange(len(some))
    while True:
        new = np.minimum(own, np.where(sub, own[None, :], n).min(1))
        new = new[new]
        if (new == own).all():
            break
        own = new
    label[some] = some[own]
    return label


def _blocks(rows: DataFrame, key: str, id_: str, n: str, block: int) -> DataFrame:
    """rows with columns i, j: the blocks of its key in which a row meets others; both blocks of each pair of blocks
    get it. Keys of at most `block` rows have the one pair (0, 0)."""
    groups = F.ceil(F.col(n) / F.lit(block)).cast("int")
    own: Column = F.pmod(F.xxhash64(F.lit(3), id_), groups.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), groups - 1))
    return rows.withColumn("own", own).withColumn("o", other).withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("o")


def _cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal (key, i, j), as one table each."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in (key, "i", "j")], 1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, z in zip(cut, cut[1:], strict=False):
            cell = tuple(k[a].tolist())
            if held and cell != now:
                yield pa.Table.from_batches(held)
                held = []
            now = cell
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def maybe_similar(sketch: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sets may be similar by their sizes and sketches, as a boolean matrix without diagonal."""
    n = len(size)
    equal, filled = np.zeros((n, n), np.int16), np.zeros((n, n), np.int16)
    for k in range(BINS):
        c = sketch[:, k]
        there = c > 0
        equal += (c[:, None] == c[None, :]) & there[:, None]
        filled += there[:, None] | there[None, :]
    out = equal >= MAYBE * filled
    out &= np.minimum(size[:, None], size[None, :]) >= least * np.maximum(size[:, None], size[None, :])
    np.fill_diagonal(out, False)
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes, by products of blocks of membership."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    values = np.concatenate(sets) if n else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(values) else new
    owner, column = owner[shared], column[shared]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    width = min(4096, int(column[-1]) + 1)
    for low in range(0, int(column[-1]) + 1, width):
        a, z = np.searchsorted(column, [low, low + width])
        dense = np.zeros((n, width), np.float32)
        dense[owner[a:z], column[a:z] - low] = 1
        out += dense @ dense.T
    return out


def _text_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with the text of the rows named by `of` (rid, doc_id): a hash that two rows share is told by the id."""
    asked = asked.withColumn("rid", F.col("of.rid"))
    return rows.join(asked, "rid").where(F.col("doc_id").eqNullSafe(F.col("of.doc_id"))).drop("rid", "doc_id")


def similar_documents(docs: DataFrame, words: int = WORDS, least: float = LEAST, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, rid, class_id, n_links, n_copies for every row of docs (doc_id, text, ...).

    n_links: the other rows whose n-gram sets have a Jaccard index of at least `least` with this row's, rows with an
    equal set included; n_copies: the rows with an equal set, itself included; class_id: the smallest doc_id of the
    component of links. A document of fewer than `words` words has one n-gram of all of them. A row without words
    (null, empty or white space) has no links, n_copies 1 and its own doc_id as class_id. Repeated rows are copies. A
    null doc_id is a document like others; a class of such rows only has a null class_id. Other columns are ignored.

    rid is a hash of (doc_id, text), for matching rows again. Pairs are found with a probability of `recall` at the
    least similarity and more above it, and of those all but about one in 100,000 pass the sketches; pairs that are found
    are compared exactly. An empty table gives an empty result. A very long text is one set like others; its n-grams are
    held in one task. Similarities of exactly `least` are links.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    runs = runs_for(recall)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64(F.lit(9), "doc_id", "text"))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            h, first = shingle_sets(b.column("text"), words)
            d1, d2 = set_digest(h, first)
            sketch = sketches(h, first)
            arrays = [
                b.column("doc_id"), b.column("rid"), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(np.diff(first)),
                _lists(*paths(h, first, runs, least), b.num_rows), pa.array([x.tobytes() for x in sketch], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rid", "d1", "d2", "size", "paths", "sketch"])

    seen = materialise(rows.mapInArrow(light, "doc_id long, rid long, d1 long, d2 long, size long, paths array<long>, sketch binary"))
    # Equal sets have equal paths and sketches.
    each = [F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.min(F.struct("rid", "doc_id")).alias("of"), *[F.first(c).alias(c) for c in ("size", "paths", "sketch")]]
    nodes = materialise(seen.where("size > 0").groupBy("d1", "d2").agg(*each).withColumn("node", F.col("d1")))
    clash = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("d2").alias("least")).where("n > 1").select(F.col("node").alias("d1"), "least")
    if clash.limit(1).count():  # different sets with one first digest: all but one are numbered by both
        nodes = nodes.join(clash, "d1", "left").withColumn("node", F.when(F.col("least") != F.col("d2"), F.xxhash64("d1", "d2")).otherwise(F.col("d1"))).drop("least")
        nodes = materialise(nodes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, first = shingle_sets(b.column("text"), words)
            lists, node = b.column("above"), np.asarray(b.column("node"))
            flat, at = lists.flatten(), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
            above, crowd = np.asarray(flat.field("path")).view(_U), np.asarray(flat.field("n"))
            for k in range(b.num_rows):
                of, path = paths_below(h[first[k] : first[k + 1]], above[at[k] : at[k + 1]], least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), node[k])), pa.array(signed(path)), pa.array(crowd[at[k] : at[k + 1]][of])], ["node", "path", "up"])

    level = nodes.select("node", F.explode("paths").alias("path"), F.lit(None).cast("long").alias("up"))
    met = []
    for depth in range(1, LEVELS + 1):
        crowd = level.groupBy("path").agg(F.count("*").alias("n")).where("n >= 2")
        level = materialise(level.join(crowd, "path"))
        deeper = (F.col("n") > small) & (2 * F.col("n") <= F.col("up"))
        if depth == 1:
            crowded = level.where(F.col("n") > small)
            share = crowded.groupBy("node").agg(F.count("*").alias("c")).join(nodes.select("node", F.size("paths").alias("all")), "node")
            apart = crowded.join(share, "node").groupBy("path").agg(F.avg(F.col("c") / F.col("all")).alias("share")).where(F.col("share") < SHARED)
            level = level.join(apart.select("path", F.lit(True).alias("apart")), "path", "left")
            deeper = F.coalesce("apart", F.lit(False))
        below = level.where(deeper)
        if depth == LEVELS or not below.limit(1).count():
            met.append(level)
            break
        met.append(level.where(~deeper))
        # A node has few paths: its list is bounded by the level's choices.
        asked = below.groupBy("node").agg(F.collect_list(F.struct("path", "n")).alias("above")).join(nodes.select("node", "of"), "node")
        # Repeated rows all match: one of them stands for the node.
        level = _text_of(rows, asked).dropDuplicates(["node"]).select("text", "node", "above").mapInArrow(choose, "node long, path long, up long")
    every = met[0].select("path", "node", "n")
    for m in met[1:]:
        every = every.unionByName(m.select("path", "node", "n"))
    met = every.join(nodes.select("node", "size", "sketch"), "node")
    cells = _blocks(met, "path", "node", "n", block).select("path", "i", "j", "node", "size", "sketch")
    cells = cells.repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for t in _cells(batches, "path"):
            node = t.column("node").to_numpy()
            keep = np.r_[True, node[1:] != node[:-1]]
            node = node[keep]
            if len(node) < 2:
                continue
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)[keep]
            label = forest(maybe_similar(sketch, t.column("size").to_numpy()[keep], least))
            moved = np.flatnonzero(label != np.arange(len(label)))
            found.append(np.stack([node[moved], node[label[moved]]]))
            if sum(x.shape[1] for x in found) > 1 << 16:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    cluster = materialise(components(cells.mapInArrow(meet, "a long, b long")))
    # Only clusters of several blocks need their size.
    sizes = cluster.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > block)
    asked = cluster.join(sizes, "component", "left").withColumn("n", F.coalesce("n", F.lit(1))).join(nodes.select("node", "of", "copies"), "node").select("of", "node", "component", "n", "copies")

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, first = shingle_sets(b.column("text"), words)
            sets = [h[a:z].tobytes() for a, z in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "n", "node", "copies")), pa.array(sets, pa.binary())], ["component", "n", "node", "copies", "members"])

    sets = _text_of(rows, asked).drop("of").mapInArrow(collect_sets, "component long, n long, node long, copies long, members binary")
    pairs = _blocks(sets, "component", "node", "n", block).select("component", "i", "j", "own", "node", "copies", "members")
    pairs = pairs.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, "component"):
            node = t.column("node").to_numpy()
            keep = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            node, copies, own = node[keep], t.column("copies").to_numpy()[keep], t.column("own").to_numpy()[keep]
            members = t.column("members").take(pa.array(keep)).to_pylist()
            sets_ = [np.frombuffer(m, np.int64) for m in members]
            size = np.fromiter(map(len, sets_), np.float64, len(sets_))
            both = intersections(sets_).astype(np.float64)
            linked = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                linked &= own[:, None] != own[None, :]  # pairs of one block are the matter of (i, i)
            links = linked @ copies
            label = forest(linked)
            some = np.flatnonzero(links > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    exact = materialise(pairs.mapInArrow(compare, "a long, b long, links long"))
    links = exact.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    component = components(exact.select("a", "b"))
    known = nodes.join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = known.groupBy("component").agg(F.min("first_doc").alias("class_id"))
    known = known.join(classes, "component").select("d1", "d2", "class_id", "component", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = F.col("size") > 0
    out = seen.select("doc_id", "rid", "size", *[F.when(some, F.col(d)).alias(d) for d in ("d1", "d2")]).join(known, ["d1", "d2"], "left")
    bare = F.col("size") == 0
    return out.select(
        "doc_id", "rid", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.when(~bare, F.col("component")).alias("component"),
    )


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """The rows of docs but for all of each class of similar documents beyond one: that with the smallest doc_id (nulls
    last). Rows without words all stay."""
    found = similar_documents(docs, words, least, recall)
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")).alias("b"))
    best = best.select(F.col("b.rid").alias("_rid"), F.col("b.doc_id").alias("_id"), F.lit(True).alias("_one"))
    stay = best.unionByName(found.where("component is null").select(F.col("rid").alias("_rid"), F.col("doc_id").alias("_id"), F.lit(False).alias("_one"))).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit(9), "doc_id", F.coalesce("text", F.lit(""))).alias("_rid"))
    rows = rows.join(stay, "_rid").where(F.col("row.doc_id").eqNullSafe(F.col("_id")))
    # Of a full duplicate one row stays.
    return rows.where("not _one").unionByName(rows.where("_one").dropDuplicates(["_rid", "_id"])).select("row.*")
