"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, size: int) -> set:
    words = SPACE_WORD.findall(fold(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs: dict, size: int, percent: int) -> dict:
    """id -> (set size, component)."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if not small or small * 100 < percent * large:
                continue
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (small + large - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(docs: list[tuple], window: int = 20) -> list[tuple]:
    """(id, words, removed, kept text) of rows already in their order."""
    seen, out = set(), []
    for i, text in docs:
        words = SPACE_WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edited(docs: list[tuple]) -> dict:
    """id -> (characters, sha of the edited text) for documents in order of id."""
    out = {}
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        out[i] = (len(text), sha(text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]))
    return out


def bm25(docs: list[tuple], queries: list[tuple], k: int) -> list[tuple]:
    term = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
    split = [(i, term.findall(fold(t or ""))) for i, t in docs]
    bags = [(i, Counter(w), len(w)) for i, w in split]
    n, mean = len(docs), sum(s for _, _, s in bags) / len(docs)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, bag, size in bags:
            s = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * size / mean))
                for t in set(term.findall(fold(text or "")))
                if t in bag
            )
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return out


def hosts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return fold(host), re.match(r"[^?#]*", rest[len(host) :])[0]
