"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import numbered
from .common import WORD, materialise

#: Bits of the hash that one level of histogram resolves, and the number of levels.
LEVEL_BITS, LEVELS = 12, 3
#: Sources whose running sums are formed in one window partition.
SOURCES = 1 << 14

_AHEAD = (Window.unboundedPreceding, -1)


def _before(rows: DataFrame, pos: str, values: dict[str, str]) -> DataFrame:
    """rows with, for each name, the sum of a column over all rows of smaller pos: in blocks of SOURCES positions, and over
    the blocks' sums."""
    cut = rows.withColumn("_b", F.floor(F.col(pos) / SOURCES))
    blocks = cut.groupBy("_b").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    over = Window.orderBy("_b").rowsBetween(*_AHEAD)  # a row for each SOURCES sources
    blocks = blocks.select("_b", *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0.0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy("_b").orderBy(pos).rowsBetween(*_AHEAD)
    cut = cut.withColumns({f"_i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for n, v in values.items()}).join(blocks, "_b")
    return cut.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat_limit: float = 3.0) -> DataFrame:
    """source, source_size and target for a table (source, source_size) of one row a source.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes. The share of a
    source ends at repeat_limit times its size; the rest goes to the others by weight until none is above. That
    fixed point is target = min(limit * size, level * weight), with the level found from running sums over the
    sources in order of limit * size / weight, so no loop is needed. Both orders are range partitioned: no task holds
    all sources.
    """
    s = numbered(sizes.select("source", F.coalesce("source_size", F.lit(0)).cast("double").alias("size")), F.col("source").isNull(), F.col("source"), name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(repeat_limit)))
    s = numbered(s, F.col("most") / F.col("weight"), F.col("place"), name="turn")
    # Long sums of whole doubles are exact up to 2**53 words.
    s = _before(s, "turn", {"used": "most", "gone": "weight"})
    total, weights_ = s.agg(F.sum("size"), F.sum("weight")).first()
    s = materialise(s.withColumn("level", (F.lit(total) - F.col("used")) / (F.lit(weights_) - F.col("gone"))))
    # The first source that stays under its limit sets the level for it and all after it.
    first = s.where(F.col("level") * F.col("weight") < F.col("most")).agg(F.min(F.struct("turn", "level")).alias("f")).first()["f"]
    target = F.col("most") if first is None else F.least(F.col("most"), F.lit(first["level"]) * F.col("weight"))
    return s.select("source", F.col("size").cast("long").alias("source_size"), target.alias("target"))


def _bucket(hash_: Column, level: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(hash_, level * LEVEL_BITS), 64 - LEVEL_BITS)


_BITS = LEVELS * LEVEL_BITS


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _goals(rows: DataFrame, weights: tuple[int, ...], repeat_limit: int) -> DataFrame:
    """For each source of rows (source, size, h): source_size, target, base (how often every document is taken), budget
    (what is then left), limit (documents whose place is below it are taken once more; null: all or none) and before
    (their size). The place is the first bits of the hash h."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sums, weights, repeat_limit)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("base", F.least(F.floor(share + 1e-12), F.lit(repeat_limit)).cast("long"))
    goal = materialise(goal.withColumn("budget", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))))

    edge = goal.select("source", "budget", F.lit(0.0).alias("before"))
    for level in range(LEVELS):
        part = _bucket(F.col("r.h"), level).alias("b")
        inside = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")))
        for up in range(level):
            inside = inside.where(_bucket(F.col("r.h"), up) == F.col(f"e.b{up}"))
        kept = [F.col(f"e.b{up}") for up in range(level)]
        hist = inside.groupBy(F.col("e.source").alias("source"), "e.budget", "e.before", *kept, part).agg(F.sum("r.size").alias("n"))
        # Of one source and bucket there is one row: at most 2**LEVEL_BITS rows stand in a window's partition.
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("before") + F.sum("n").over(run))
        names = [f"b{up}" for up in range(level)]
        first = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("b", "n", "upto")))
        edge = hist.groupBy("source", "budget", *names).agg(first.alias("f")).where("f is not null")
        edge = materialise(edge.select("source", "budget", *names, F.col("f.b").alias(f"b{level}"), (F.col("f.upto") - F.col("f.n")).cast("double").alias("before")))

    limit = F.lit(0).cast("long")
    for i in range(LEVELS):
        limit = limit + F.shiftleft(F.col(f"b{i}").cast("long"), _BITS - LEVEL_BITS * (i + 1))
    edge = edge.select(F.col("source").alias("edge_source"), limit.alias("limit"), "before")
    # A source without an edge spends its whole budget on all documents, or has none.
    goal = goal.join(edge, goal.source.eqNullSafe(edge.edge_source), "left").drop("edge_source")
    return materialise(goal.withColumnRenamed("source", "goal_source"))


def _with_copies(rows: DataFrame, goal: DataFrame, repeat_limit: int) -> DataFrame:
    """rows (source, size, h, ...) with source_size, target and copies, how often each is taken to meet the goals.

    Where the budget ends inside a bucket that can't be refined further, its rows are taken in order of their hash, and
    of rows that share even that (repeated rows) as many as come nearest. These are counted, not compared: they get
    numbers inside the partitions they lie in, behind the counts of the partitions before.
    """
    out = rows.join(goal, rows.source.eqNullSafe(goal.goal_source)).drop("goal_source")
    place = F.shiftrightunsigned("h", 64 - _BITS)
    taken = lambda extra: F.least(F.col("base") + extra, F.lit(repeat_limit)).cast("long").alias("copies")
    names = [*rows.columns, "source_size", "target"]
    open_ = F.col("limit").isNotNull() & (place == F.col("limit"))
    clear = out.where(~open_).select(*names, taken(F.when(F.col("limit").isNull(), F.col("budget") > 0).otherwise(place < F.col("limit")).cast("int")))

    edge = materialise(out.where(open_).withColumn("mid", F.monotonically_increasing_id()))
    edge = edge.withColumn("part", F.shiftright("mid", 33)).withColumn("_source", F.struct("source"))
    group = ["_source", "h"]
    # Few rows: an edge's hashes, then the partitions that hold one of them.
    kinds = edge.groupBy(*group, "budget", "before").agg(F.first("size").alias("each"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum(F.col("each") * F.col("n")).over(Window.partitionBy("_source").orderBy("h").rowsBetween(*_AHEAD)), F.lit(0))
    left = F.col("budget") - F.col("before") - ahead
    kinds = kinds.select(*group, F.when(F.col("each") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.round(left / F.col("each"))))).otherwise(F.lit(0)).cast("long").alias("quota"))
    parts = edge.groupBy(*group, "part").agg(F.count("*").alias("rows"))
    offset = F.coalesce(F.sum("rows").over(Window.partitionBy(*group).orderBy("part").rowsBetween(*_AHEAD)), F.lit(0))
    parts = parts.select(*group, "part", offset.alias("offset")).join(kinds, group)
    number = F.row_number().over(Window.partitionBy(*group, "part").orderBy("mid"))
    edge = edge.withColumn("number", number).join(parts, [*group, "part"])
    return clear.unionByName(edge.select(*names, taken((F.col("number") + F.col("offset") <= F.col("quota")).cast("int"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat_limit: int = 3) -> DataFrame:
    """How often each document of (doc_id, text, source, ...) enters a mix with the given source weights.

    Returns doc_id, size, source_size, target, taken and copies (taken = copies * size), one row for each input
    row. Every document of a source is taken floor(target / source_size) times; the rest of the target goes to the
    documents whose hash is below the source's threshold. The threshold comes from sums of size by source and
    hash bucket: the bucket in which the budget ends is refined with the next bits of the hash, and only that one.
    Of what LEVELS levels can't tell apart as many rows are taken as come nearest to the target, so rows that repeat
    are split too. Nothing is sorted by document.

    Null or empty texts have size 0 and are taken 0 words; a null source is a source of its own, the last one. Very
    long texts are taken whole or not at all. An empty table gives an empty result. Other columns are ignored. Which
    documents are taken depends on doc_id and text only, so reruns agree.
    """
    rows = materialise(docs.select("doc_id", "source", _size().alias("size"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h")))
    out = _with_copies(rows, _goals(rows, weights, repeat_limit), repeat_limit)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "h")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat_limit: int = 3) -> DataFrame:
    """The documents of the mix, each as often as mix() takes it; the columns of docs. Documents without words stay once:
    they weigh nothing. The texts don't move: every row is decided where it lies."""
    # The whole row travels as a struct, so no column of docs can clash with those added here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", _size().alias("size"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h"))
    out = _with_copies(rows, _goals(materialise(rows.select("source", "size", "h")), weights, repeat_limit), repeat_limit)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    return out.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
