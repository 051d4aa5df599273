"""Benchmark decontamination with suffix arrays of the training texts.

Each slice of documents is a shard. Its words become numbers (0: a word of no benchmark
item; a word counts as an item's only if their bytes are equal) and a suffix array is built
over them: suffixes are ordered by their first ``window`` words and then, by doubling, by
all of them. Every suffix of every benchmark item is looked up in it by binary search. The
interval of suffixes that begin with the item's window gives all its places in the shard,
and runs of places on one diagonal are the longest verbatim matches of the document that
hold a window. ``longest_matches`` gives the longest match of each item, however short, and
where it stands.

One reduction loses nothing: runs of known words shorter than the shortest window hold none.

The benchmark is the stated query set. It goes to the executors in blocks of at most
``BLOCK_BYTES`` of text, one at a time, with one pass over the documents for each, which
appends what it found to the rows; so the result does not depend on the number of blocks.

Null or empty texts have no words, are never hit and are kept; an empty benchmark hits
nothing; items that share an id count once, items without an id count as one more; repeated
documents stay rows of their own; an empty table gives no rows. Other columns may have any
names. A very long text is one slice, with about 150 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded_batches, drop, stored, with_columns

WINDOW = 10
#: Most text of benchmark items that is sent to the executors at once.
BLOCK_BYTES = 4 << 20


@dataclass
class Queries:
    """All suffixes of a block of benchmark items, as word numbers."""

    of: dict  # the number of each distinct word, from 1
    number: np.ndarray  # of each item word; each is the start of a suffix
    left: np.ndarray  # words of the suffix
    item: np.ndarray
    start: np.ndarray  # its place in the item
    window: np.ndarray  # words of the window that starts there, 0 where none does
    lows: np.ndarray  # lower and upper end of the search interval of each suffix
    highs: np.ndarray
    names: list

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words of a lower-cased text."""
        distinct, own = T.spans(low, starts, ends)
        return np.array([self.of.get(x, 0) for x in distinct], np.int64)[own]


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = T.lower_ascii(buf)
    return low, *T.words(low, offsets, T.ALNUM)


def build_queries(ids: list, texts: list, window: int = WINDOW) -> Queries:
    low, starts, ends, row = _words(*T.flat(pa.array(texts, pa.string())))
    strings, own = T.spans(low, starts, ends)
    number = own + 1
    bounds = T.row_bounds(row, len(texts))
    size = np.diff(bounds)[row] if len(row) else np.zeros(0, np.int64)
    start = np.arange(len(row)) - bounds[row] if len(row) else np.zeros(0, np.int64)
    left = size - start
    n = np.minimum(left, window)
    prefix = np.where(np.arange(window) < n[:, None], _following(number, window), 0)
    highs = np.where(np.arange(window) < n[:, None], prefix, np.iinfo(np.int32).max)
    at = np.where((left >= window) | (start == 0), n, 0)
    return Queries({x: k for k, x in enumerate(strings, 1)}, number, left, row, start, at, _keys(prefix), _keys(highs), [None if x is None else str(x) for x in ids])


def _following(number: np.ndarray, window: int) -> np.ndarray:
    """The ``window`` numbers from each place on."""
    padded = np.concatenate([number, np.zeros(window, number.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, window)[: len(number)]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings whose order is that of the rows."""
    raw = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, rows.shape[1] % 2))).astype(">u4"))
    return raw.view(f"V{4 * raw.shape[1]}").ravel() if len(raw) else np.zeros(0, f"V{4 * raw.shape[1]}")


def suffix_array(number: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (number[c : c + left[c]]) in ascending order, ties by place, and the keys of their first words."""
    first = np.where(np.arange(window) < left[:, None], _following(number, window), 0)
    order = np.lexsort(first.T[::-1]) if len(first) else np.zeros(0, np.int64)
    keys = _keys(first[order])
    if not len(order):
        return order, keys
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.empty(len(order), np.int64)  # place in the order of the first suffix that is equal so far
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    known = window
    while True:
        at = rank[order]
        tied = np.flatnonzero(np.concatenate((at[1:] == at[:-1], [False])) | np.concatenate(([False], at[1:] == at[:-1])))
        own = order[tied]
        more = left[own] > known
        if not more.any():
            return order, keys
        after = np.zeros(len(own), np.int64)
        after[more] = rank[own[more] + known] + 1
        by = np.lexsort((own, after, rank[own]))
        own, after, old = own[by], after[by], rank[own][by]
        order[tied] = own
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])))
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        known *= 2


def _search(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in sorted keys."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    raw, want = keys.view(np.uint8).reshape(len(keys), keys.itemsize).view(">u8"), wanted.view(np.uint8).reshape(len(wanted), wanted.itemsize).view(">u8")
    while len(keys) and (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(keys) - 1)
        differs = raw[mid] != want
        at = differs.argmax(axis=1)
        k = np.arange(len(wanted))
        a, b = raw[mid, at], want[k, at]
        right = np.where(differs.any(axis=1), a < b, after)
        low = np.where(open_ & right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


@dataclass
class Shard:
    """The suffix array of a slice of documents over its runs of known words."""

    counts: np.ndarray  # words of each row
    place: np.ndarray  # of each known word: its row, place in the row, number, words to the end of its run
    number: np.ndarray
    row: np.ndarray
    left: np.ndarray
    order: np.ndarray
    keys: np.ndarray


def build_shard(queries: Queries, buf: np.ndarray, offsets: np.ndarray, window: int, shortest: int) -> Shard:
    low, starts, ends, row = _words(buf, offsets)
    bounds = T.row_bounds(row, len(offsets) - 1)
    number = queries.numbers(low, starts, ends)
    stop = np.ones(len(number) + 1, bool)
    stop[:-1] = number == 0
    at = np.flatnonzero(stop)
    here = np.arange(len(number))
    end = np.minimum(at[np.searchsorted(at, here)], bounds[row + 1]) if len(row) else here
    begin = np.maximum(np.append(-1, at)[np.searchsorted(at, here)] + 1, bounds[row]) if len(row) else here
    kept = np.flatnonzero((number > 0) & (end - begin >= shortest))
    order, keys = suffix_array(number[kept], (end - here)[kept], window)
    return Shard(np.diff(bounds), kept - bounds[row[kept]], number[kept], row[kept], (end - here)[kept], order, keys)


def find(queries: Queries, buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts per row, and for each occurrence of a window its row, first word in the row and suffix."""
    real = np.flatnonzero(queries.window)
    shard = build_shard(queries, buf, offsets, window, int(queries.window[real].min(initial=window)))
    low = _search(shard.keys, queries.lows[real], False)
    n = _search(shard.keys, queries.highs[real], True) - low
    which = np.repeat(real, n)
    at = shard.order[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    return shard.counts, shard.row[at], shard.place[at], which


def _common(queries: Queries, shard: Shard, suffix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the common prefix of item suffixes and suffixes of the shard."""
    out = np.zeros(len(suffix), np.int64)
    most = np.minimum(queries.left[suffix], shard.left[at])
    own = np.flatnonzero(most > 0)
    while len(own):
        own = own[queries.number[suffix[own] + out[own]] == shard.number[at[own] + out[own]]]
        out[own] += 1
        own = own[out[own] < most[own]]
    return out


def longest_run(item: np.ndarray, place: np.ndarray, start: np.ndarray, length: np.ndarray) -> int:
    """Words of the longest verbatim match: windows that follow each other in text and item."""
    if not len(item):
        return 0
    order = np.lexsort((place, place - start, item))
    i, p, d = item[order], place[order], (place - start)[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(i)))
    return int((size - 1 + length[order][begin]).max())


def _spans(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint word ranges that the windows cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], (first + length)[order]
    top = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    begin = np.flatnonzero(new)
    return a[begin], top[np.append(begin[1:], len(a)) - 1]


_SCHEMA = "n_words long, item_ids array<string>, span_starts array<long>, span_ends array<long>, longest_match long"


def _scan(rows: DataFrame, queries: Queries, window: int) -> DataFrame:
    """(k, text) or what an earlier scan returned, with what this block's windows hit."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    before = names[1] in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, j in T.slices(offsets):
                counts, rows_, first, which = find(queries, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                order = np.argsort(rows_, kind="stable")
                bounds = T.row_bounds(rows_[order], j - i)
                out[0] += counts.tolist()
                for k in range(j - i):
                    own = order[bounds[k] : bounds[k + 1]]
                    if not len(own):
                        for x, v in zip(out[1:], ([], [], [], 0), strict=True):
                            x.append(v)
                        continue
                    w, f = which[own], first[own]
                    a, z = _spans(f, queries.window[w])
                    out[1].append([queries.names[x] for x in np.unique(queries.item[w])])
                    out[2].append(a.tolist())
                    out[3].append(z.tolist())
                    out[4].append(longest_run(queries.item[w], f, queries.start[w], queries.window[w]))
            if before:  # what the blocks before this one found
                for k in (1, 2, 3):
                    out[k] = [x + y for x, y in zip(b.column(names[k]).to_pylist(), out[k], strict=True)]
                out[4] = np.maximum(b.column(names[4]).to_numpy(), np.array(out[4], np.int64)).tolist()
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("text"), *columns], names=["k", "text", *names])

    return rows.mapInArrow(run, with_columns(rows.select("k", "text"), _SCHEMA))


def query_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The benchmark in blocks by a hash of its rows, none far above ``block_bytes``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + int(total) // block_bytes
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: (r["item"] is None, r["item"] or "", r["text"]))
        yield build_queries([r["item"] for r in rows], [r["text"] for r in rows], window)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, item_ids, spans (word ranges), longest_match, contaminated."""
    rows = bounded_batches(documents).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    old: list = []
    for k, q in enumerate(query_blocks(benchmark, item_col, text_col, window, block_bytes)):
        # written between blocks, so that no plan or task holds more than one of them
        now: list = []
        rows = _scan(stored(rows, now) if k else rows, q, window)
        drop(documents.sparkSession, old)
        old = now
    found = rows.drop("text")
    zipped = F.array_sort(F.arrays_zip("span_starts", "span_ends"))
    merged = F.aggregate(
        zipped,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("top")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["span_ends"] - F.greatest(x["span_starts"], a["top"]))).alias("n"),
            F.greatest(a["top"], x["span_ends"]).alias("top"),
        ),
    )
    return found.select(
        F.col("k").alias(id_col), "n_words", merged["n"].alias("n_hit"), F.size(F.array_distinct("item_ids")).cast("long").alias("n_items"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), zipped.alias("spans"), "longest_match"
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``documents`` without the rows that hold a window of the benchmark; all columns stay."""
    rows = documents.withColumn("__row", F.struct(*documents.columns)).select("__row", F.col(text_col).alias("text"))
    found = find_contamination(rows, benchmark, window, id_col="__row")
    return found.where(~F.col("contaminated")).select(*[F.col("__row")[c].alias(c) for c in documents.columns])


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, length, item_start, id_col, doc_start): the longest verbatim match of each item in words.

    Of equally long matches the one that starts first in the item, then in the least id.
    Items that match nowhere have no row; documents without an id take no part.
    """
    rows = bounded_batches(documents).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def scan(queries: Queries) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                buf, offsets = T.flat(b.column("text"))
                for i, j in T.slices(offsets):
                    shard = build_shard(queries, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, 1)
                    if not len(shard.order) or not len(queries.number):
                        continue
                    # the longest match of a suffix stands beside its place in the order
                    every = np.arange(len(queries.number))
                    low, high = _search(shard.keys, queries.lows, False), _search(shard.keys, queries.highs, True)
                    while (open_ := np.flatnonzero(low < high)).size:  # beyond the first words
                        mid = (low[open_] + high[open_]) // 2
                        at = shard.order[mid]
                        n = _common(queries, shard, open_, at)
                        ended = n == queries.left[open_]
                        a = np.where(n < shard.left[at], shard.number[np.minimum(at + n, len(shard.number) - 1)], 0)
                        c = queries.number[np.minimum(open_ + n, len(queries.number) - 1)]
                        right = ~ended & (a < c)
                        low[open_[right]] = mid[right] + 1
                        high[open_[~right]] = mid[~right]
                    near = [np.clip(low + d, 0, len(shard.order) - 1) for d in (-1, 0)]
                    size = np.stack([_common(queries, shard, every, shard.order[x]) for x in near])
                    best = size.argmax(axis=0)
                    n, at = size.max(axis=0), shard.order[np.where(best == 0, *near)]
                    order = np.lexsort((queries.start, -n, queries.item))
                    top = order[np.concatenate(([True], np.diff(queries.item[order]) != 0))]
                    top = top[n[top] > 0]
                    keys = b.column("k").take(pa.array(i + shard.row[at[top]]))
                    yield pa.RecordBatch.from_arrays([pa.array([queries.names[x] for x in queries.item[top].tolist()], pa.string()), pa.array(n[top]), pa.array(queries.start[top]), keys, pa.array(shard.place[at[top]])], names=["item_id", "length", "item_start", "k", "doc_start"])

        return rows.mapInArrow(run, f"item_id string, length long, item_start long, k {kind}, doc_start long")

    found = None
    for q in query_blocks(benchmark, item_col, text_col, window, block_bytes):
        one = stored(scan(q))
        found = one if found is None else found.union(one)
    best = F.min_by(F.struct("length", "item_start", "k", "doc_start"), F.struct(-F.col("length"), "item_start", "k", "doc_start")).alias("m")
    return found.groupBy("item_id").agg(best).select("item_id", "m.length", "m.item_start", F.col("m.k").alias(id_col), "m.doc_start")
