"""Byte-level BPE encoding in linear time by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Pre-tokens whose ids a worker keeps, and pairs of tokens whose compatibility it keeps.
KEPT, KEPT_PAIRS = 300_000, 2_000_000


def read_ranks(file: bytes) -> list[bytes]:
    """The tokens of a rank file by rank, which must be 0, 1, 2, ..."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks aren't 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class ByteBPE:
    """Encodes as merging the pair of lowest rank again and again would, without doing the merges.

    A sequence of tokens is the result of the merges exactly if each two neighbours are, for their own bytes. So the
    encoder takes the longest token that matches (found with an Aho-Corasick automaton over the bytes as Latin-1) and
    is compatible with the token before; where none is, it goes back one token and tries that one's shorter prefixes,
    never trying an end twice that failed.
    """

    def __init__(self, file: bytes, pattern: str):
        self.vocab = vocab = read_ranks(file)
        self.split = regex.compile(pattern)
        rank = {t: i for i, t in enumerate(vocab)}
        if not all(bytes([b]) in rank for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.size = [len(t) for t in vocab]
        self.pair: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(vocab)
        self.halves = [(i, i) for i in range(len(vocab))]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(vocab):
            self.automaton.add_word(t.decode("latin-1"), i)
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None:
                    self.shorter[i] = a
                    if b is not None:
                        self.pair[a, b] = i
        self.automaton.make_automaton()
        self.one = [rank[bytes([b])] for b in range(256)]
        for i, t in enumerate(vocab):
            if len(t) > 1:
                self.halves[i] = self._last_merge(t, i)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[list[int], str]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this token."""
        parts = [self.one[b] for b in token]
        while len(parts) > 2:
            best = min((self.pair.get(p, rank), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is never the result of merges")
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of a and b together end at a, b.

        They don't if some token that ends a and some that begins b, at the time when both stand there, merge. Going
        back in time, the younger of the two is split until both are single bytes.
        """
        key = a * len(self.vocab) + b
        if (known := self.fits.get(key)) is not None:
            return known
        pair, halves, limit, fits = self.pair, self.halves, len(self.vocab), True
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < limit:
                fits = False
                break
            left, right = halves[a], halves[b]
            split_a, split_b = left[1] != a, right[0] != b
            if not split_a and not split_b:
                break
            # Merges happen in order of rank, and of one rank from left to right: the later one is undone first.
            if split_a and (not split_b or a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        longest = [-1] * (len(piece) + 1)
        size = self.size
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # of one start the longer match ends later
        if not piece:
            return []
        if size[longest[0]] == len(piece):
            return [longest[0]]
        ids: list[int] = []
        dead = bytearray(len(piece) + 1)
        shorter, compatible = self.shorter, self.compatible
        at, token = 0, longest[0]
        while token >= 0:
            end = at + size[token]
            if not dead[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                last = ids.pop()
                at -= size[last]
                token = shorter[last]
                while token < 0:
                    dead[at] = 1
                    last = ids.pop()
                    at -= size[last]
                    token = shorter[last]
        return ids

    def pieces(self, text: str) -> list[tuple[list[int], str]]:
        """Ids, and the ids in decimal, of each pre-token of a text."""
        known, out = self.known, []
        if len(known) > KEPT:
            known.clear()
        for piece in self.split.findall(text):
            got = known.get(piece)
            if got is None:
                ids = self.encode_piece(piece.encode())
                got = known[piece] = ids, " ".join(map(str, ids))
            out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.pieces(text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_loaded: dict[int, ByteBPE] = {}


def encoder(file: bytes, pattern: str) -> ByteBPE:
    """The encoder of a rank file, built once in a worker."""
    key = hash((file, pattern))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(file, pattern)
    return _loaded[key]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of (doc_id, text); a null text is empty and has no ids. Other columns are
    ignored, whatever their names.

    ranks: the path of a rank file, read by the driver and broadcast; pattern: the split before the merges.
    """
    with open(ranks, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file.value, pattern)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and bytes of every row of (doc_id, ids); null ids give no bytes."""
    with open(ranks, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = read_ranks(file.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(vocab.__getitem__, ids or [])) for ids in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids, in one pass.

    ids_sha256 is the digest of the decimal ids joined by one space. A null text is empty; repeated rows each get
    their row; an empty table gives an empty result; a very long text is encoded whole; other columns are ignored.
    """
    with open(ranks, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file.value, pattern)
        for b in slices(batches, "text"):
            n, coded, decoded = [], [], []
            for text in b.column(1).to_pylist():
                pieces = bpe.pieces(text or "")
                ids = [i for x, _ in pieces for i in x]
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join([s for _, s in pieces]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
