"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def contamination(rows: list[tuple[int, str | None]], items: list[tuple[object, str | None]], width: int = 10) -> dict[int, tuple]:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for name, text in items:
        w = re.findall(pattern, lower(text or ""))
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(name))
    sizes = sorted({len(k) for k in windows})
    out = {}
    for i, text in rows:
        w = re.findall(pattern, lower(text or ""))
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    names |= windows[key]
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
