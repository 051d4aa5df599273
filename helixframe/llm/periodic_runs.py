"""Periodic runs of words: maximal pairs of the LCP-interval tree.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words long, that no
neighbouring word extends. Its words from the first to q before its end, and the same words
q later, are a maximal pair: the words before both differ, and so do those after both. So runs
are read off the maximal pairs (i, i + q, l) whose distance is short for their length,
3 q <= l, with no step that extends matches. The texts of a slice are ranked together by prefix doubling, as
numpy arrays in which each text ends with a separator of its own; LCPs come from the ranks of
the doublings. The interval tree above LCP 5 is walked from the bottom. A node holds its
suffixes by position, each with the class of its left word; a child's suffixes look up their
neighbours among the node's, and pairs of different classes are maximal. Neighbours suffice,
as an occurrence between the two would give the run a smaller period. Pairs at a multiple
of a run's period have its start and end, so the smallest period of each stretch is the run's.

A null or blank text has no words, no runs, four nulls and the hashes of an empty string.
Repeated rows give repeated rows, an empty table gives none; other columns, whatever their
names, are ignored. A null id is returned as null. A very long text is held whole in one task,
with about 8 bytes for each of its words and doublings.
"""

from __future__ import annotations

import zlib
from bisect import bisect
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded_batches, with_columns

#: Fewest words of a run, and fewest periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Least length of a maximal pair that belongs to a run: 5 at period 1, 3 q beyond.
LEAST_LCP = 5


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``x`` and the ranks of its strings of 1, 2, 4, ... items.

    The last item occurs once, so no repeated string reaches the end. Strings that occur once
    drop out of the later rounds.
    """
    n = len(x)
    sa = np.argsort(x, kind="stable")
    s = x[sa]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    at, width = np.arange(n), 1
    rank = np.empty(n, np.int64)
    levels = []
    while len(at):
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[sa[at]] = at[first][group]
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        at = at[np.diff(np.append(first, len(at)))[group] > 1]
        p = sa[at]
        one, two = rank[p], rank[p + width]
        order = np.lexsort((two, one))
        sa[at] = p[order]
        one, two = one[order], two[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(at) else new[:0]
        width *= 2
    return sa, levels


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """LCP of the suffixes sa[i - 1] and sa[i] for each i of ``at``."""
    a, b = sa[at - 1], sa[at]
    out = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][a + out] == levels[k][b + out]).astype(np.int64) << k
    return out


def _maximal_pairs(sa: list[int], lcp: list[int], left: list[int], found: list[tuple[int, int, int]]) -> None:
    """Adds (start, distance, length) of the maximal pairs of one subtree whose distance is short.

    sa: its suffixes in order; lcp: with the one before; left: the class of the word before.
    """
    stack: list[list] = []  # [lcp, suffixes by position] of the open intervals
    of = dict(zip(sa, left, strict=True))

    def merged(a: list[int], b: list[int], l: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        most = l // (LEAST_PERIODS - 1)
        places = [bisect(a, p) for p in b]
        for p, k in zip(b, places, strict=True):
            if k and p - a[k - 1] <= most and of[a[k - 1]] != of[p] and p - a[k - 1] + l >= LEAST_WORDS:
                found.append((a[k - 1], p - a[k - 1], l))
            if k < len(a) and a[k] - p <= most and of[a[k]] != of[p] and a[k] - p + l >= LEAST_WORDS:
                found.append((p, a[k] - p, l))
        for shift, (p, k) in enumerate(zip(b, places, strict=True)):
            a.insert(k + shift, p)
        return a

    last = [sa[0]]
    for p, l in zip(sa[1:], lcp[1:], strict=True):
        while stack and stack[-1][0] > l:
            above, own = stack.pop()
            last = merged(own, last, above)
        if stack and stack[-1][0] == l:
            stack[-1][1] = merged(stack[-1][1], last, l)
        else:
            stack.append([l, last])
        last = [p]
    while stack:
        above, own = stack.pop()
        last = merged(own, last, above)


def find_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``x`` by start, then period.

    Every text of ``x`` ends with an item that occurs once in ``x``.
    """
    none = np.zeros(0, np.int64)
    if len(x) < LEAST_WORDS:
        return none, none, none
    sa, levels = suffix_order(x)
    if len(levels) < 3:
        return none, none, none
    four = levels[2]
    at = np.flatnonzero(four[sa[1:]] == four[sa[:-1]]) + 1
    lcp = neighbour_lcp(sa, levels, at)
    at, lcp = at[lcp >= LEAST_LCP], lcp[lcp >= LEAST_LCP]
    if not len(at):
        return none, none, none
    # subtrees above LCP 5: stretches of the suffix array
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    first, end = at[np.concatenate(([0], cut))] - 1, at[np.concatenate((cut - 1, [len(at) - 1]))] + 1
    size = end - first
    tree = np.repeat(np.arange(len(size)), size)
    index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[tree]
    full = np.zeros(len(sa), np.int64)
    full[at] = lcp
    # a subtree whose closest suffixes are further apart than its longest LCP allows has no run
    p = sa[index]
    order = np.lexsort((p, tree))
    gap = np.diff(p[order])
    gap[np.diff(tree[order]) != 0] = len(x)
    begin = np.cumsum(size) - size
    closest = np.minimum.reduceat(np.append(gap, len(x)), begin)
    closest[size == 1] = len(x)
    good = closest * (LEAST_PERIODS - 1) <= np.maximum.reduceat(full[index], begin)
    found: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(good).tolist():
        own = sa[first[i] : end[i]]
        left = np.where(own > 0, x[own - 1], -1)
        _maximal_pairs(own.tolist(), full[first[i] : end[i]].tolist(), left.tolist(), found)
    if not found:
        return none, none, none
    start, period, length = np.array(found, np.int64).T
    length = length + period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated_order(key: str, n: int) -> np.ndarray | None:
    """Numbers of the words that a text of ``n`` words is rebuilt from, None if it stays as it is.

    One text in ten, by the crc32 of its key, repeats a stretch of its words to its end.
    """
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _digests(keys: list[str | None], column: pa.Array, order: Callable[[str, int], np.ndarray | None] | None) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    buf, offsets = T.flat(column)
    for lo, hi in T.slices(offsets):
        part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = T.words(part, at, T.NOT_BLANK)
        distinct, number = T.spans(part, starts, ends)
        bounds = T.row_bounds(row, hi - lo)
        source = np.arange(len(number))
        for r in range(hi - lo):
            key = keys[lo + r]
            moved = order(key, int(bounds[r + 1] - bounds[r])) if order and key is not None else None
            if moved is not None:
                source[bounds[r] : bounds[r + 1]] = bounds[r] + moved
        number = number[source]
        # texts one after the other: words of different texts differ, each text ends with a separator
        base = bounds[:-1] + np.arange(hi - lo)
        x = np.empty(len(number) + hi - lo, np.int64)
        x[np.arange(len(number)) + row] = number + row * (len(distinct) + 1)
        x[bounds[1:] + np.arange(hi - lo)] = np.arange(hi - lo) * (len(distinct) + 1) + len(distinct)
        start, length, period = find_runs(x)
        mine = np.searchsorted(start, np.append(base, len(x)))
        for r in range(hi - lo):
            words = number[bounds[r] : bounds[r + 1]]
            i, j = mine[r], mine[r + 1]
            runs = list(zip((start[i:j] - base[r]).tolist(), length[i:j].tolist(), period[i:j].tolist(), strict=True))
            best = None
            if runs:
                kept = np.ones(len(words), bool)
                for s, n, q in runs:
                    kept[s + q : s + n] = False
                    if best is None or n * best[2] > best[1] * q:
                        best = (s, n, q)
                words = words[kept]
            out["n_runs"].append(len(runs))
            for c, v in zip(("start", "length", "period", "exponent_milli"), (*best, 1000 * best[1] // best[2]) if best else (None,) * 4, strict=True):
                out[c].append(v)
            out["runs_sha256"].append(sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
            out["collapsed_sha256"].append(sha256(b" ".join([distinct[k] for k in words.tolist()])).hexdigest())
    return out


def detect_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Callable[[str, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: id_col, n_runs, the run of greatest length / period (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256 (the words that no run repeats).

    ``order`` gives, for an id as text and a number of words, the words to rebuild a text from.
    """
    wanted = bounded_batches(documents).select(F.col(id_col), F.col(id_col).cast("string").alias("__key"), F.col(text_col).cast("string").alias("__text"))
    schema = with_columns(documents.select(id_col), "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _digests(b.column(1).to_pylist(), b.column(2), order)
            columns = [pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *out])

    return wanted.mapInArrow(run, schema)


def collapse_runs(text: str | None) -> str | None:
    """``text`` with each run cut to its first period, words joined by one space; null stays null."""
    if text is None:
        return None
    words = text.encode().split()
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([*(number[w] for w in words), len(number)], np.int64)
    kept = np.ones(len(words), bool)
    for s, n, q in zip(*find_runs(x), strict=True):
        kept[s + q : s + n] = False
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k]).decode()


def collapse(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` whose texts are collapsed by collapse_runs(); all columns stay."""
    again = F.udf(collapse_runs, "string", useArrow=True)
    return bounded_batches(documents).withColumn(text_col, again(F.col(text_col).cast("string")))
