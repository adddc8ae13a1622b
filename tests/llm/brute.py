"""Plain versions of the operators that SQL cannot express, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def byte_dedup(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    docs = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, float] = defaultdict(lambda: float("inf"))
    order = lambda i: float("inf") if i is None else i
    for i, t in docs:
        for p in range(len(t) - window + 1):
            least[t[p : p + window]] = min(least[t[p : p + window]], order(i))
    out = []
    for i, t in docs:
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if order(i) > least[t[p : p + window]]:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def word_dedup(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, float] = defaultdict(lambda: float("inf"))
    order = lambda i: float("inf") if i is None else i
    for i, t in docs:
        for p in range(len(t) - window + 1):
            least[tuple(t[p : p + window])] = min(least[tuple(t[p : p + window])], order(i))
    out = []
    for i, t in docs:
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if order(i) > least[tuple(t[p : p + window])]:
                gone[p : p + window] = [True] * window
        out.append((i, len(t), sum(gone), sha(" ".join(w for w, g in zip(t, gone, strict=True) if not g).encode())))
    return out


def contamination(rows: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], window: int = 10) -> list[tuple]:
    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (whose := windows.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    found |= whose
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), sha(",".join(names).encode()), any(hit)))
    return out


def greedy(word: str, first: set[str], rest: set[str]) -> int:
    """Pieces of a word, each the longest that fits; -1 if one place has none."""
    word, at, n = "▁" + word, 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (rest if at else first):
                at, n = end, n + 1
                break
        else:
            return -1
    return n
