"""Suffix-array removal of byte strings that occur more than once, across shards.

1. Anchors. Every window of WINDOW bytes picks the gram of ANCHOR bytes with the least hash inside it, the rightmost
   of equals. Two equal windows pick the same gram at the same offset, so equal windows meet at equal anchors.
   Anchors that occur once in the corpus (counted with map-side sums) need no further work.
2. Pieces. The piece of an anchor is what the windows that pick it cover: at most 2 * WINDOW - ANCHOR bytes, fewer on
   average, and each window is in one piece only. Pieces of one anchor with equal bytes (by the anchor's hash and 64
   bits of xxHash over the bytes) are one piece with a count; only one representative's bytes travel.
3. Shards. The pieces of every anchor that repeats form a shard, in parts of about SHARD_PIECES pieces if there are
   more. Each part gets a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's method; windows
   whose first WINDOW bytes equal those of a neighbour, at the same offset from the anchor, or whose piece counts
   twice, are repeated. Nothing is removed that no suffix array has seen.
4. Merging. Of shards in several parts, each part sends one of each of its windows' 128-bit digests in order; a part's
   windows are looked up in the merged order of the parts before it by binary search.
5. Each document gets the ranges of its own pieces and removes their union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, materialise, mix, prefix, shuffle_parts, signed, slices, text_bytes

WINDOW, ANCHOR = 200, 48
SHARD_PIECES = 1024
#: Pieces that go into one suffix array at least, if there are as many: larger arrays leave the caches.
TOGETHER = 1024

_U = np.uint64
_REST = _U(0xFFFFFFFFFF000000)
_CHUNK = 1 << 22


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, from running minima of blocks in both directions."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, _U)
    padded[:n] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of a batch of texts: position, text, hash of the anchor, and the piece as [start, end) with its hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = ANCHOR):
        reach = window - gram
        sums, inverse = prefix(_BYTE[data])
        n = len(data)
        size = np.diff(at)
        long = size >= window
        step = np.zeros(n + 1, np.int8)
        np.add.at(step, at[:-1][long], 1)
        np.add.at(step, at[1:][long] - window + 1, -1)
        inside = np.cumsum(step[:n], dtype=np.int8).astype(bool)  # where a window of one text starts
        parts = []
        for low in range(0, max(n - window + 1, 0), _CHUNK):
            high = min(low + _CHUNK, n - window + 1)  # windows that start in [low, high)
            h = mix((sums[low + gram : high + window] - sums[low : high + reach]) * inverse[low : high + reach] + _U(gram))
            h &= _REST
            h |= np.arange(high + reach - low, 0, -1).astype(_U)
            w = np.flatnonzero(inside[low:high])
            pick = (high + reach) - (_least(h, reach + 1)[w] & ~_REST).astype(np.int64)
            w += low
            first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]]) if len(pick) else w
            last = np.r_[first[1:], len(pick)] - 1 if len(pick) else w
            parts.append((pick[first], w[first], w[last]))
        p, begin, final = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        new = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)  # an anchor of two chunks
        first = np.flatnonzero(new)
        self.pos = p = p[first]
        self.doc = np.searchsorted(at, p, side="right") - 1
        self.anchor = mix((sums[p + gram] - sums[p]) * inverse[p] + _U(gram))
        self.start = begin[first]
        self.end = final[np.r_[first[1:], len(new)] - 1] + window if len(first) else self.start
        view = memoryview(np.ascontiguousarray(data))
        spans = zip(self.start.tolist(), self.end.tolist(), strict=True)
        own = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in spans), _U, len(p))
        left = (p - self.start).astype(_U)
        self.piece = mix(own + left * _U(0xC2B2AE3D27D4EB4F))


def _both(anchor: np.ndarray, piece: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One 64-bit key of an anchor, its piece and the place of its text in the batch."""
    return mix(mix(anchor ^ (piece * _U(0x9E3779B97F4A7C15))) + doc.astype(_U) * _U(0xD6E8FEB86659FD93))


def suffix_array(text: np.ndarray, piece: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of text (bytes of pieces end to end) in order of their suffixes, which end with their piece.

    Of equal suffixes that of the earlier piece comes first. piece: the piece of each position, end: where it ends.
    Larsson-Sadakane: order by the first symbols, then only groups of still equal suffixes are ordered again by the
    rank of what follows, with twice the known depth each time.
    """
    n, depth = len(text), 7
    sym = np.zeros(n + depth, np.int64)
    sym[:n] = text
    sym[:n] += 1
    left = end - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= 9
        key += sym[k : n + k] * (left > k)
    order = np.argsort(key)  # any order inside groups: they are refined
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    pieces = int(piece[-1]) + 1 if n else 0
    # Behind its piece's end a suffix has the piece's own symbol, below all ranks.
    rank, behind = np.zeros(n + depth, np.int64), piece
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + pieces
    while True:
        # A group is unsorted if its rank is not only its first place's.
        slot = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(slot):
            return order
        if depth > len(rank) - n:
            rank = np.r_[rank[:n], np.zeros(depth, np.int64)]
        key = rank[:n] * np.int64(n + pieces)
        key += np.where(left > depth, rank[depth : n + depth], behind)
        at = order[slot]
        value = key[at]
        again = np.argsort(value)
        at, value = at[again], value[again]
        order[slot] = at
        fresh = np.r_[True, value[1:] != value[:-1]]
        new[slot] = fresh
        rank[at] = slot[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + pieces
        depth *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For each position with `most` bytes to the end of its piece the length, at most `most`, of what its suffix shares with
    the one before it in order; 0 for other positions.

    Kasai: from one position to the next the shared length falls by one at most. All pieces are walked at the same
    time, one comparison of each per step. start, end: of each piece.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    stop = np.repeat(end, end - start)
    shared = np.zeros(n, np.int64)
    last = end - most + 1
    live = np.flatnonzero(start < last)
    i, last, own = start[live], last[live], end[live]
    h = np.zeros(len(i), np.int64)
    j = before[i]
    limit = np.minimum(np.minimum(own - i, most), np.where(j >= 0, stop[j] - j, 0))
    while len(i):
        go = h < limit
        go[go] = text[i[go] + h[go]] == text[j[go] + h[go]]
        h += go
        halt = np.flatnonzero(~go)
        at = i[halt]
        shared[at] = h[halt]
        h[halt] = np.maximum(h[halt] - 1, 0)
        at += 1
        i[halt] = at
        nbr = before[at]
        j[halt] = nbr
        limit[halt] = np.minimum(np.minimum(own[halt] - at, most), np.where(nbr >= 0, stop[nbr] - nbr, 0))
        if (at >= last[halt]).any():
            keep = i < last
            i, h, j, limit, last, own = i[keep], h[keep], j[keep], limit[keep], last[keep], own[keep]
    return shared


def repeated_windows(pieces: list[bytes], left: np.ndarray, count: np.ndarray, group: np.ndarray, window: int = WINDOW):
    """The windows of a shard's pieces that occur more than once, and those that occur once.

    left: bytes before the anchor in each piece; count: how often the piece occurs; group: its anchor, numbered.
    Returns (piece, rel, repeated, first) for every window of pieces: rel is its start from the anchor (<= 0), first
    marks one window of each set of equal ones.
    """
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(pieces)), size)
    order = suffix_array(text, owner, end[owner])
    shared = common_prefixes(text, order, start, end, window)
    kind = np.empty(len(text), np.int64)
    kind[order] = np.cumsum(shared[order] < window)
    rel = np.arange(len(text)) - start[owner] - left[owner]
    at = np.flatnonzero((rel <= 0) & (np.arange(len(text)) + window <= end[owner]))
    owner, rel, kind = owner[at], rel[at], kind[at]
    # Equal windows of one anchor at one offset are different places of the corpus; at other offsets the same place
    # could have come with two anchors.
    key = (kind * np.int64(group.max() + 1) + group[owner]) * np.int64(window + 1) - rel
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    times = np.bincount(of, weights=count[owner])
    is_first = np.zeros(len(at), bool)
    is_first[first] = True
    return owner, rel, times[of] >= 2, is_first


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = ANCHOR, shard_pieces: int = SHARD_PIECES, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Removes each byte that a string of `window` bytes covers which also starts anywhere else in the texts.

    docs: (doc_id, text, ...). Returns doc_id, kept (binary, the bytes that stay), n_bytes, n_removed, n_spans for
    every row. The texts count as UTF-8 bytes, null as empty; no string crosses documents; strings are judged on the
    input. Texts shorter than the window keep everything. Of repeated rows each is a document of its own, so all their
    windows are repeated. A null doc_id is a document like others. Of the other columns those named in carry come with
    the result as a struct `others` (each with _ before its name), the rest are ignored. as_text: kept is a string; where a removed string
    began or ended inside a character, the rest of that character goes too. An empty table gives an empty result; a very
    long text is one text, whose windows a task holds at once.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    # rid tells rows apart but for full duplicates, which share all results. A collision of rids does no harm: what a
    # row gets is looked up by its own anchors and pieces.
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{c}") for c in carry]).alias("others")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), others).withColumn("rid", F.xxhash64(F.lit(8), "doc_id", "text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            a = Anchors(*text_bytes(b.column(1)), window, gram)
            if not len(a.pos):
                continue
            _, first, n = np.unique(_both(a.anchor, a.piece, a.doc), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a.doc[first])), pa.array(signed(a.anchor[first])), pa.array(signed(a.piece[first])), pa.array(n.astype(np.int32))], ["rid", "anchor", "piece", "n"])

    # Written, as it is read twice: to count anchors and to keep the frequent ones.
    found = materialise(rows.select("rid", "text").mapInArrow(anchors, "rid long, anchor long, piece long, n int"))
    often = found.groupBy("anchor").agg(F.sum("n").alias("total")).where("total >= 2").select("anchor")
    found = materialise(found.join(often, "anchor").select("rid", "anchor", "piece", "n"))

    pieces = found.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"))
    # Only shards in several parts need their number of pieces: few rows, so that the pieces may stay where they are.
    pieces = materialise(pieces)
    kinds = pieces.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > shard_pieces)
    pieces = pieces.join(kinds, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    asked = pieces.groupBy("rid").agg(F.collect_list(F.struct("anchor", "piece", "n", "kinds")).alias("asked"))
    touched = found.select("rid").distinct().join(asked, "rid", "left").withColumn("hit", F.lit(True))
    held = materialise(
        rows.join(touched, "rid", "left").select(
            "doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("hit", F.lit(False)).alias("hit"), "text", "asked", "others"
        )
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = text_bytes(b.column("text"))
            a = Anchors(data, at, window, gram)
            lists = b.column("asked")
            doc = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            want = {k: np.asarray(flat.field(k)) for k in ("anchor", "piece", "n", "kinds")}
            key = _both(want["anchor"].view(_U), want["piece"].view(_U), doc)
            own, first = np.unique(_both(a.anchor, a.piece, a.doc), return_index=True)
            place = np.minimum(np.searchsorted(own, key), len(own) - 1)
            right = own[place] == key
            place, want = first[place[right]], {k: v[right] for k, v in want.items()}
            split = -(-want["kinds"] // shard_pieces)
            bytes_ = [data[s:e].tobytes() for s, e in zip(a.start[place].tolist(), a.end[place].tolist(), strict=True)]
            part = (want["piece"].view(_U) % split.astype(_U)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(want["anchor"]), pa.array(part), pa.array(split > 1), pa.array(want["piece"]), pa.array(want["n"]), pa.array((a.pos - a.start)[place].astype(np.int32)), pa.array(bytes_, pa.binary())],
                ["anchor", "part", "split", "piece", "n", "left", "bytes"],
            )

    sent = held.where("asked is not null").select("text", "asked").mapInArrow(cut, "anchor long, part int, split boolean, piece long, n long, left int, bytes binary")
    sent = sent.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part", "piece")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(tables)
            anchor, part, piece = (t.column(k).to_numpy() for k in ("anchor", "part", "piece"))
            fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (piece[1:] != piece[:-1])]
            if not fresh.all():  # a full duplicate of the representative row sends its pieces too
                t = t.filter(pa.array(fresh))
                anchor, part, piece = anchor[fresh], part[fresh], piece[fresh]
            group = np.cumsum(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]) - 1
            left, count, split = t.column("left").to_numpy().astype(np.int64), t.column("n").to_numpy(), t.column("split").to_numpy(zero_copy_only=False)
            bytes_ = t.column("bytes").to_pylist()
            owner, rel, twice, first = repeated_windows(bytes_, left, count, group, window)
            low, high = np.full(len(anchor), 1, np.int64), np.full(len(anchor), -window, np.int64)
            np.minimum.at(low, owner[twice], rel[twice])
            np.maximum.at(high, owner[twice], rel[twice])
            some = np.flatnonzero(low <= 0)
            yield _solved(anchor[some], piece[some], low[some], high[some] + window)
            open_ = np.flatnonzero(split[owner] & (first | ~twice))
            if len(open_):  # windows of shards in several parts go on to the merge
                of = owner[open_]
                key = _window_digests(bytes_, of, rel[open_] + left[of], window, anchor[of], rel[open_])
                yield from _to_merge(key, anchor[of], piece[of], part[of], rel[open_], parts)

        held_, n, now = [], 0, None
        for b in batches:
            anchor, part = b.column("anchor").to_numpy(), b.column("part").to_numpy()
            border = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            cuts = [0, *border.tolist()] if now is not None and b.num_rows and (anchor[0], part[0]) != now else border.tolist()
            begin = 0
            for c in cuts:
                if n + c - begin >= TOGETHER:
                    if c > begin:
                        held_.append(b.slice(begin, c - begin))
                    if held_:
                        yield from solve(held_)
                    held_, n, begin = [], 0, c
            if b.num_rows > begin:
                held_.append(b.slice(begin))
                n += b.num_rows - begin
            if b.num_rows:
                now = (anchor[-1], part[-1])
        if held_:
            yield from solve(held_)

    solved = materialise(sent.mapInArrow(search, "anchor long, piece long, low long, high long, target int, keys binary, rows binary"))
    waiting = solved.where("target is not null").select("target", "keys", "rows")
    waiting = waiting.repartition(parts, "target").sortWithinPartitions("target")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        now = None
        for b in batches:
            for target, keys, rows_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if target != now and held:
                    yield _merged(held, window)
                    held = []
                now = target
                held.append((keys, rows_))
        if held:
            yield _merged(held, window)

    merged = waiting.mapInArrow(merge, "anchor long, piece long, low long, high long")
    ranges = solved.where("target is null").select("anchor", "piece", "low", "high").unionByName(merged)
    ranges = ranges.groupBy("anchor", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mine = found.select("rid", "anchor", "piece").distinct().join(ranges, ["anchor", "piece"])
    mine = mine.groupBy("rid").agg(F.collect_list(F.struct("anchor", "piece", "low", "high")).alias("ranges"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = text_bytes(b.column("text"))
            lists = b.column("ranges")
            gone = np.zeros(len(data) + 1, np.int32)
            if lists.null_count < b.num_rows:
                doc = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                flat = lists.flatten()
                key = _both(np.asarray(flat.field("anchor")).view(_U), np.asarray(flat.field("piece")).view(_U), doc)
                by = np.argsort(key)
                key, low, high = key[by], np.asarray(flat.field("low"))[by], np.asarray(flat.field("high"))[by]
                a = Anchors(data, at, window, gram)
                if len(key) and len(a.pos):
                    own = _both(a.anchor, a.piece, a.doc)
                    place = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    hit = key[place] == own
                    s = np.maximum(a.pos[hit] + low[place[hit]], a.start[hit])
                    e = np.minimum(a.pos[hit] + high[place[hit]], a.end[hit])
                    np.add.at(gone, s, 1)
                    np.add.at(gone, e, -1)
            covered = np.cumsum(gone[:-1]) > 0
            out = _kept(b.column("doc_id"), data, at, covered).append_column("others", b.column("others"))
            if as_text:
                out = out.set_column(1, "kept", pa.array([x.decode("utf-8", "ignore") for x in out.column(1).to_pylist()], pa.string()))
            yield out

    whole = F.col("text") if as_text else F.encode("text", "utf-8")
    kinds = held.select("doc_id", whole.alias("kept"), *[F.col("n_bytes").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], "others")
    rest = held.where("not hit").select("doc_id", whole.alias("kept"), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "others")
    done = held.where("hit").select("rid", "doc_id", "text", "others").join(mine, "rid", "left").select("doc_id", "text", "ranges", "others").mapInArrow(remove, kinds.schema)
    out = rest.unionByName(done)
    return out if carry else out.drop("others")


#: A window's digest: of its bytes, and where it stands from which anchor.
_KEY = np.dtype([("a", ">u8"), ("b", ">u8")])


def _window_digests(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, window: int, anchor: np.ndarray, rel: np.ndarray) -> np.ndarray:
    own = b"".join([xxhash.xxh3_128_digest(pieces[i][s : s + window]) for i, s in zip(owner.tolist(), start.tolist(), strict=True)])
    key = np.frombuffer(own, _KEY).copy()
    place = mix(anchor.view(_U) + rel.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15))
    key["a"] ^= place
    key["b"] ^= mix(place + _U(1))
    return key


_SOLVED = ["anchor", "piece", "low", "high", "target", "keys", "rows"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
_ROW = np.dtype([("anchor", np.int64), ("piece", np.int64), ("rel", np.int16), ("part", np.int32)])


def _solved(anchor: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(anchor), k) for k in _KINDS[4:]]
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(piece), pa.array(low), pa.array(high), *empty], _SOLVED)


def _to_merge(key: np.ndarray, anchor: np.ndarray, piece: np.ndarray, part: np.ndarray, rel: np.ndarray, targets: int) -> Iterator[pa.RecordBatch]:
    """Open windows as one row for each range of their digests: sorted digests, and what they belong to."""
    order = np.lexsort((key["b"], key["a"]))
    rows = np.empty(len(key), _ROW)
    rows["anchor"], rows["piece"], rows["rel"], rows["part"] = anchor, piece, rel, part
    key, rows = key[order], rows[order]
    target = (key["a"].astype(_U) >> _U(32)) * _U(targets) >> _U(32)
    cut = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1).tolist(), len(key)]
    ranges = list(zip(cut, cut[1:], strict=False))
    empty = [pa.nulls(len(ranges), k) for k in _KINDS[:4]]
    yield pa.RecordBatch.from_arrays([*empty, pa.array(target[cut[:-1]].astype(np.int32)), pa.array([key[a:z].tobytes() for a, z in ranges], pa.binary()), pa.array([rows[a:z].tobytes() for a, z in ranges], pa.binary())], _SOLVED)


class _Run:
    """Windows in order of their digests, each once; again: which another part has too."""

    def __init__(self, key: np.ndarray, rows: np.ndarray, again: np.ndarray):
        self.key, self.rows, self.again = key, rows, again

    def merged(self, other: _Run) -> tuple[_Run, np.ndarray]:
        """Both runs as one, by binary search of the other's digests in this one's, and the rows of the other's hits."""
        at = np.searchsorted(self.key, other.key)
        hit = np.zeros(len(at), bool)
        if len(self.key):
            hit = self.key[np.minimum(at, len(self.key) - 1)] == other.key
        self.again[at[hit]] = True
        new = ~hit
        put = [np.insert(x, at[new], y[new]) for x, y in ((self.key, other.key), (self.rows, other.rows), (self.again, other.again))]
        return _Run(*put), other.rows[hit]


def _merged(held: list[tuple[bytes, bytes]], window: int) -> pa.RecordBatch:
    """The ranges of pieces from their open windows that another part has too: runs of about one size are merged by turns."""
    stack: list[_Run] = []
    extra: list[np.ndarray] = []

    def join(top: int) -> None:
        while len(stack) > 1 and len(stack[-2].key) <= top * len(stack[-1].key):
            last = stack.pop()
            stack[-1], found = stack[-1].merged(last)
            extra.append(found)

    for k, r in held:
        # As strings of bytes the digests sort as they came.
        key, rows = np.frombuffer(k, "S16"), np.frombuffer(r, _ROW)
        fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]  # two parts of an anchor may have been solved together
        first = np.flatnonzero(fresh)
        extra.append(rows[~fresh])
        stack.append(_Run(key[first], rows[first], np.diff(np.r_[first, len(key)]) > 1))
        join(2)
    while len(stack) > 1:
        join(len(stack[0].key) + 1)
    rows = np.concatenate([*(x.rows[x.again] for x in stack), *extra])
    both = mix(np.ascontiguousarray(rows["anchor"]).view(_U)) ^ np.ascontiguousarray(rows["piece"]).view(_U)
    order = np.lexsort((rows["rel"], both))
    rows, both = rows[order], both[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(both)] - 1 if len(both) else first
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k][first])) for k in ("anchor", "piece")] + [pa.array(rows["rel"][first].astype(np.int64)), pa.array(rows["rel"][last].astype(np.int64) + window)], ["anchor", "piece", "low", "high"])


def _kept(doc_id: pa.Array, data: np.ndarray, at: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    """A row for each text: the bytes that aren't covered, and counts of bytes, removed bytes and removed runs."""
    edge = covered.copy()
    edge[1:] &= ~covered[:-1]
    begin = at[:-1][np.diff(at) > 0]
    edge[begin] = covered[begin]
    gone, runs = (np.r_[0, np.cumsum(x)] for x in (covered, edge))
    stay = data[~covered]
    to = np.arange(len(data) + 1) - gone
    kept = [stay[to[s] : to[e]].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(kept, pa.binary()), pa.array(np.diff(at)), pa.array(gone[at[1:]] - gone[at[:-1]], pa.int64()), pa.array(runs[at[1:]] - runs[at[:-1]], pa.int64())],
        ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with text (and n_chars, if there is one) as it is without repeated strings; see remove_repeats.
    Emptied documents stay."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, window, carry=carry, as_text=True)
    size = {"n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in carry else {}
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"others.`_{c}`") for c in carry} | size
    return out.select(*[back[c].alias(c) for c in docs.columns])


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats with the lower-case hex SHA-256 of the kept bytes in their place."""
    return remove_repeats(docs, window).withColumn("kept_sha256", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


__all__ = ["Anchors", "common_prefixes", "removal_digests", "remove_repeats", "repeated_windows", "suffix_array", "without_repeats"]
