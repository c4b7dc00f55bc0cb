"""Token counts of byte-level BPE by merging ragged arrays, one rank of every sequence at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Fixed: the split of text before the merges, as byte-level tokenizer files with use_regex define it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose counts a worker keeps, and bytes of new ones that are merged together.
KEPT, TOGETHER = 400_000, 1 << 20

_NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class TokenCounter:
    """Counts tokens as a tokenizer file (.json, byte-level BPE) has them."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is counted")
        self.symbol = np.array([vocab.get(c, -1) for c in byte_letters()], np.int64)
        if (self.symbol < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that survive the merges of each non-empty piece.

        All pieces stand end to end in one array. In each round every piece applies its own lowest rank at all places
        at once; of overlapping places the first, third, ... of a run. A finished piece leaves the array.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        counts = size.copy()
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            done = best == _NONE
            if done.any():
                counts[owner[start[done]]] = length[done]
                keep = np.repeat(~done, length)
                sym, owner, rank = sym[keep], owner[keep], rank[keep]
                best, length = best[~done], length[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[run % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, owner, rank = sym[stay], owner[stay], rank[stay]
            at = place[hit]
            redo = np.unique(np.r_[at, at[at > 0] - 1])
            last = redo == len(sym) - 1
            rank[redo[last]] = _NONE
            redo = redo[~last]
            same = owner[redo] == owner[redo + 1]
            rank[redo[~same]] = _NONE
            redo = redo[same]
            rank[redo] = self._ranks(sym[redo], sym[redo + 1])
        return counts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Special strings count as one token each and split the text, as the library does."""
        known, found, new, special = self.known, [], {}, []
        if len(known) > KEPT:
            known.clear()
        for text in texts:
            n = 0
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                n = len(parts) - 1
            pieces = self.split.findall(parts[0]) if len(parts) == 1 else [x for p in parts for x in self.split.findall(p)]
            special.append(n)
            found.append(pieces)
            new.update(dict.fromkeys(x for x in pieces if x not in known))
        batch, size = [], 0
        todo = list(new)
        for i, piece in enumerate(todo):
            batch.append(piece)
            size += len(piece)
            if size >= TOGETHER or i == len(todo) - 1:
                known.update(zip(batch, self.merge_counts([x.encode() for x in batch]).tolist(), strict=True))
                batch, size = [], 0
        return [n + sum(map(known.__getitem__, pieces)) for n, pieces in zip(special, found, strict=True)]


_loaded: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text), by the tokenizer file at a path.

    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows each get their row, an empty
    table gives an empty result, a very long text is counted whole; other columns are ignored.
    The file is read by the driver and broadcast: its size is that of a vocabulary, not of the data.
    """
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(file.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = TokenCounter(file.value)
        counter = _loaded[key]
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
