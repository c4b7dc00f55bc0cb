"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_bytes(texts: list[str | None], window: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, sha256 of what is kept of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_words(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple[int, int, str]]:
    """n_words, n_removed, sha256 of the kept words; a window goes if it also starts in a document of smaller id."""
    first: dict[tuple[str, ...], int] = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None and first[key] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0)))


def jaccard_links(texts: list[str | None], least: float, k: int = 5) -> list[tuple[int, int]]:
    sets = [shingles(t, k) for t in texts]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    out = []
    for i, s in enumerate(sets):
        for j in sorted({j for x in s for j in by[x] if j > i}):
            if len(s & sets[j]) >= least * len(s | sets[j]):
                out.append((i, j))
    return out
