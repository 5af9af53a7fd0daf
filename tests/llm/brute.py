"""The operators' results by plain loops over small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def counted_shingles(text: str | None) -> frozenset:
    w, seen, found = words(text), Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        shingle = tuple(w[i : i + 5])
        seen[shingle] += 1
        found.append((shingle, seen[shingle]))
    return frozenset(found)


def near_classes(docs: dict[int, str | None], similarity: float = 0.8, sets_of=shingles) -> dict[int, int]:
    """The smallest id of each id's component, by similarities of all pairs that share a shingle."""
    sets = {d: sets_of(text) for d, text in docs.items()}
    parent = {d: d for d in docs}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in where[x] if e < d)
        for e, n in shared.items():
            if n >= similarity * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def holds(text: str | None, item: str) -> bool:
    return f" {' '.join(words(item))} " in f" {' '.join(words(text))} "
