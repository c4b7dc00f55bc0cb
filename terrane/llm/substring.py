"""Removal of word sequences that also stand in an earlier document, by fixed blocks and rolling windows.

1. Index. Every document is a reference: its non-overlapping blocks of BLOCK words, by hash, with the smallest
   document that has the block. A window of WINDOW = 2 * BLOCK words holds a whole block of any document it stands in.
2. Probe. Every rolling run of BLOCK words is looked up. Both sides travel as sorted packed arrays, one row for a
   hash range and a slice of text, not a row for each word. A hit is a block of a document with a smaller id.
3. Extend. Around hits, windows that hold the block at any offset are looked up in the same way, by two independent
   hashes of all their words (94 bits), each made from its own hash of every word's bytes. A window whose sequence
   starts in a smaller document goes; consecutive ones make up the maximal exact repeat around the block. The words of
   a repeat are told by these hashes, not fetched from the other document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialise, mix, shuffle_parts, slices, text_bytes

WINDOW = 50
#: Bytes of text whose hashes are packed together: more take fewer bytes for each hash.
TOGETHER = 4 << 20
#: Tasks among which the probes of a range of blocks are dealt (each has the range's index), text for each task, about, and
#: tasks at most unless the session asks for more.
SPREAD, TASK_BYTES, MOST_TASKS = 4, 16 << 20, 1 << 17

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as their first value and the differences, in as few bytes each as the largest takes."""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + values[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    step = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(step) + 1, 8), np.uint8)
    full[1:, :width] = step
    full[0] = np.frombuffer(packed, np.uint8, 8, 1)
    return np.cumsum(full.view(_U).ravel(), dtype=_U)


def _small(ids: np.ndarray) -> bytes:
    kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + ids.astype(kind).tobytes()


def _read_small(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if packed[0] == 2 else np.uint32, offset=1)


def _rows(kind: int, h: np.ndarray, check: np.ndarray | None, doc: np.ndarray, ids: np.ndarray, bits: int, ranges: int, spread: int) -> list[tuple]:
    """Rows (part, kind, hashes, checks, docs, ids) of hashes with the place of their document in ids, by range of the hash.

    A range is a number of parts, `spread` of them: all get the index, one the probes of these documents.
    """
    if not len(h):
        return []
    if check is None:
        check = np.zeros(len(h), np.uint32)
    least = ids[doc]
    # The index needs each hash's smallest document only.
    order = np.lexsort((doc if kind else least, check, h))
    h, check, doc = h[order], check[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (bool(kind) & (doc[1:] != doc[:-1]))]
    h, check, doc = h[new], check[new], doc[new]
    part = (h >> _U(bits - 32)) * _U(ranges) >> _U(32)
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(h)]
    salt = int(mix(ids[:1].view(_U))[0] % _U(spread))
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        used, place = np.unique(doc[a:b], return_inverse=True)
        own = ids[used]
        by = np.argsort(own, kind="stable")  # ids in order differ by little
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by))
        row = (kind, pack(h[a:b]), check[a:b].tobytes() if check.any() else b"", _small(turn[place]), pack(own[by].view(_U)))
        out += [(int(part[a]) * spread + s, *row) for s in ([salt] if kind else range(spread))]
    return out


_NAMES = ["part", "kind", "hashes", "checks", "docs", "ids"]
_SENT = "part int, kind int, hashes binary, checks binary, docs binary, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


#: Answers that a lookup task gathers before it sends them.
_GATHER = 1 << 19


def _answers(found: list[tuple[np.ndarray, np.ndarray]], parts: int, width: int) -> pa.RecordBatch:
    """Rows (target, docs, counts, hits) of (documents, hashes), one for each target, which is a hash range of documents: each
    document once with its number of hashes, and the hashes' low `width` bytes."""
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    target = mix(doc.view(_U)) % _U(parts)
    order = np.lexsort((h, doc, target))
    doc, h, target = doc[order], h[order], target[order]
    low = h.view(np.uint8).reshape(-1, 8)[:, :width]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)]).astype(np.uint32)
    owner, docs = target[first], doc[first]
    cut = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
    at = np.r_[first, len(doc)]
    rows = [(int(owner[x]), docs[x:z].tobytes(), count[x:z].tobytes(), low[at[x] : at[z]].tobytes()) for x, z in zip(cut, cut[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["target", "docs", "counts", "hits"])


def _by_document(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, hits) for each document of a target, from the rows of _answers in order of target."""
    held: list[tuple[bytes, bytes, bytes]] = []
    now = None

    def close() -> Iterator[pa.RecordBatch]:
        doc, count, low = (b"".join(x) for x in zip(*held, strict=True))
        held.clear()
        doc = np.repeat(np.frombuffer(doc, np.int64), np.frombuffer(count, np.uint32))
        h = np.zeros((len(doc), 8), np.uint8)
        h[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
        h = h.view(_U).ravel()
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        cut = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)]
        for low_ in range(0, len(cut) - 1, 1000):
            some = cut[low_ : low_ + 1001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[np.array(some[:-1])]), pa.array([pack(h[x:z]) for x, z in zip(some, some[1:], strict=False)], pa.binary())], ["doc_id", "hits"])

    for b in batches:
        for target, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if target != now and held:
                yield from close()
            now = target
            held.append(tuple(row))
    if held:
        yield from close()


def _lookup(sent: DataFrame, parts: int, bits: int, references: bool) -> DataFrame:
    """doc_id and the hashes that are indexed for a smaller document. With references, a document whose indexed hash
    another one hits is told so too.

    A task holds the index of its hash range (each slice sends a hash once, with its smallest document) and lets the
    probes stream past, so a hash that a third of all documents have costs time, not memory; the probes of a block are
    dealt among SPREAD tasks.
    """
    width = (bits + 7) // 8
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh, found = None, [], []
        h, check, least, used = np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

        def index() -> None:
            nonlocal h, check, least, used
            if fresh:
                h_, check_, doc_ = (np.concatenate(x) for x in zip((h, check, least), *fresh, strict=True))
                order = np.lexsort((doc_, check_, h_))
                h_, check_, doc_ = h_[order], check_[order], doc_[order]
                first = np.r_[True, (h_[1:] != h_[:-1]) | (check_[1:] != check_[:-1])]
                h, check, least = h_[first], check_[first], doc_[first]
                used = np.zeros(len(h), bool)
                fresh.clear()

        def close() -> None:
            nonlocal h, check, least, used
            if references and used.any():
                found.append((least[used], h[used]))
            h, check, least, used = np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
            fresh.clear()

        def look(value: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where each pair of hashes stands in the index, and whether it does."""
            at = np.searchsorted(h, value)
            while True:
                at = np.minimum(at, len(h) - 1)
                hit = (h[at] == value) & (check[at] == wide)
                on = ~hit & (h[at] == value) & (at + 1 < len(h))
                on[on] = h[at[on] + 1] == value[on]  # another one with the same first hash
                if not on.any():
                    return at, hit
                at = at + on

        def send(most: int) -> Iterator[pa.RecordBatch]:
            if found and sum(len(x) for x, _ in found) > most:
                yield _answers(found, parts, width)
                found.clear()

        for b in batches:
            for part, kind, hashes, checks, docs, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    close()
                    now = part
                value, doc = unpack(hashes), unpack(ids).view(np.int64)[_read_small(docs)]
                wide = np.frombuffer(checks, np.uint32) if checks else np.zeros(len(value), np.uint32)
                if not kind:
                    fresh.append((value, wide, doc))
                    if sum(len(x[0]) for x in fresh) > 1 << 20:
                        index()
                    continue
                index()
                if not len(h):
                    continue
                at, hit = look(value, wide)
                hit &= least[at] < doc
                if hit.any():
                    used[at[hit]] = True
                    found.append((doc[hit], value[hit]))
                    yield from send(_GATHER)
        close()
        yield from send(0)

    answers = dealt.mapInArrow(run, "target int, docs binary, counts binary, hits binary")
    return answers.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(lambda b: _by_document(b, width), "doc_id long, hits binary")


def _hits(packed: pa.Array) -> np.ndarray:
    found = [unpack(x) for x in packed.to_pylist() if x is not None]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, _U)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes each word that a run of `window` words covers which also starts in a document with a smaller doc_id.

    docs: (doc_id, text, ...). Returns doc_id, kept (string: the words that stay, joined by one space), n_words and
    n_removed for every row. Words are runs of anything but ASCII white space, unchanged; a null text has none.
    Windows are judged on the input and lie in one document. Rows that repeat a doc_id don't count against each other.
    A row without doc_id takes no part: it keeps its words and is no reference. Other columns are ignored.

    An empty table gives an empty result; a very long text is one document like others and its words are held in one
    task. A window is known by 94 bits of two independent hashes: of n windows that lie around hits, about n * n / 2**95
    pairs are taken for equal in error.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Enough bits that a false hit is rare (it only costs a lookup of its windows), and not more to send.
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(60, max(36, int(total // (4 * block) + 1).bit_length() + 14))
    ranges = -(-max(shuffle_parts(spark), min(int(total // TASK_BYTES), MOST_TASKS)) // SPREAD)
    parts = ranges * SPREAD

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TOGETHER):
            ids = np.asarray(b.column(0))
            w = Words(*text_bytes(b.column(1)))
            h, at = w.grams(block)
            h >>= _U(64 - bits)
            doc = w.doc[at]
            aligned = (at - w.first[doc]) % block == 0
            if out := [*_rows(0, h[aligned], None, doc[aligned], ids, bits, ranges, SPREAD), *_rows(1, h, None, doc, ids, bits, ranges, SPREAD)]:
                yield _batch(out)

    known = rows.where("doc_id is not null")
    hits = _lookup(known.mapInArrow(probe, _SENT), parts, bits, references=True)
    held = materialise(rows.join(hits, "doc_id", "left"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TOGETHER):
            ids = np.asarray(b.column(0))
            w = Words(*text_bytes(b.column(1)))
            word = w.hashes()
            h, at = w.grams(block, word)
            hot = at[np.isin(h >> _U(64 - bits), _hits(b.column(2)))]
            wide, start = w.grams(window, word)
            near = np.zeros(len(word) + 1, np.int32)
            np.add.at(near, np.maximum(hot - (window - block), 0), 1)
            np.add.at(near, hot + 1, -1)
            close = np.cumsum(near)[start] > 0
            h, doc = wide[close] >> _U(2), w.doc[start[close]]
            check = (w.grams(window, w.hashes(seed=1))[0][close] >> _U(32)).astype(np.uint32)
            if out := [*_rows(0, h, check, doc, ids, 62, parts, 1), *_rows(1, h, check, doc, ids, 62, parts, 1)]:
                yield _batch(out)

    gone = _lookup(held.where("hits is not null").mapInArrow(extend, _SENT), parts, 62, references=False)
    rest = held.where("hits is null").select("doc_id", "text", F.lit(None).cast("binary").alias("gone"))
    done = held.where("hits is not null").select("doc_id", "text").join(gone.withColumnRenamed("hits", "gone"), "doc_id", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(*text_bytes(b.column(1)))
            cover = np.zeros(len(w.doc) + 1, np.int32)
            lists = b.column(2)
            if lists.null_count < b.num_rows:
                h, at = w.grams(window)
                h >>= _U(2)
                for d in np.flatnonzero(np.asarray(lists.is_valid())).tolist():  # of one text after the other: a window can be right in one only
                    mine = slice(*np.searchsorted(at, w.first[d : d + 2]).tolist())
                    start = at[mine][np.isin(h[mine], _hits(lists.slice(d, 1)))]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + window, -1)
            stays = np.cumsum(cover[:-1]) <= 0
            data = w.data.tobytes()
            kept, removed = [], []
            start, end = w.start.tolist(), w.end.tolist()
            for d in range(b.num_rows):
                a, z = int(w.first[d]), int(w.first[d + 1])
                own = np.flatnonzero(stays[a:z]) + a
                kept.append(b" ".join([data[start[i] : end[i]] for i in own.tolist()]))
                removed.append(z - a - len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return done.select("doc_id", "text", "gone").unionByName(rest).mapInArrow(remove, "doc_id long, kept string, n_words long, n_removed long")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats with the lower-case hex SHA-256 of the kept words in their place."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
