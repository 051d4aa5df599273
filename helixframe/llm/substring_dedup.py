"""Removal of long strings that occur earlier, decided by suffix arrays.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (in a document of
smaller id, or earlier in the same one) goes; strings are judged on the input. Steps:

1. A window is a WIDTH-byte string. Its anchor is the GRAM-byte string in it of least
   hash, the leftmost on ties, so equal windows have equal anchors at equal places. Hashes
   of anchors are counted over all documents; windows whose anchor is unique cannot
   repeat and drop out.
2. Neighbouring windows with one anchor are a context. A block of documents keeps the
   earliest place of each distinct context with a repeated anchor; its later places in the
   block are removed at once. So a passage that a third of all documents hold is one entry
   for each block, to whose anchor's shard text and earliest place are sent.
3. A shard cuts contexts down to windows whose hash repeats and merges equal ones. Texts
   that share a window hash with another text are sorted by their suffixes, by Lyndon
   grouping: windows that are equal stand side by side in the suffix array (checked byte by
   byte). Of each set of equal windows the earliest place stays and all others are removed.
4. The removed ranges go back to their documents, which are cut and hashed.

A hash only ever drops what cannot repeat; a collision costs work, no result. Contexts of
anchors that stand at more than ``HOT`` places may differ without bound (a common line in
different surroundings), so their windows go one by one, as 128-bit keyed digests with the
earliest place in the block, each to a shard of its own; the earliest of equal digests
stays. So an anchor's contexts never gather in one task, and one suffix array is over
``SORT_BYTES`` and the texts of one anchor, ``HOT`` contexts at most.

Documents are rows. Null texts are empty; texts shorter than WIDTH stay whole. Rows with
one id are ordered by the digest of their text; rows that repeat both id and text are
one document, and each gets its result. A null id comes before all others; ids must be
whole numbers. Other columns, whatever their names, are ignored. An empty table gives no
rows. A very long text is held whole in one task, its hashes by slices of 2 MB or, if one
text is longer, of that text (about 60 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text as T
from ._spark import bounded_batches, dealt, drop, stored
from .lm_score import _blocks
from .suffix_sort import suffix_array

WIDTH = 100
GRAM = 32
HOT = 2_000
#: Bytes of the corpus for each shard of anchors.
SHARD_BYTES = 8 << 20
#: Bytes that one suffix array is built over, and up to one anchor's texts more.
SORT_BYTES = 192 << 10
_NULL_ID = np.iinfo(np.int64).min


def contexts(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, last window (positions in buf) and row of each context."""
    n = len(buf) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    v = T.mix(T.rolling_hash(T.prefix_hash(buf), gram))
    # hash above, position below: the least is the leftmost of the least hashes
    least = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(v), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        rest = span - size
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    p = np.flatnonzero(offsets[row + 1] >= np.arange(n) + width)
    if not len(p):
        return np.zeros(0, np.uint64), none, none, none
    a = anchor[p]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (np.diff(p) != 1))))
    last = np.append(first[1:], len(p)) - 1
    return v[a[first]], p[first], p[last], row[p[first]]


def equal_windows(texts: list[bytes], width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of equal windows in the texts, as (text, offset) arrays, one pair for each set.

    Only sets of two or more are returned. Found by one suffix array over all texts.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    joined = b"\0".join(texts)
    if len(texts) < 2:
        return out
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    order = np.array(suffix_array(joined), np.int64)
    text = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[text]
    real = offset <= sizes[text] - width
    order, text, offset = order[real], text[real], offset[real]
    raw = np.frombuffer(joined, np.uint8)
    same = np.ones(max(len(order) - 1, 0), bool)
    for i in range(0, len(same), 8192):
        a, b = order[i : i + 8192][: len(same) - i], order[i + 1 : i + 8193]
        same[i : i + 8192] = (raw[a[:, None] + np.arange(width)] == raw[b[:, None] + np.arange(width)]).all(axis=1)
    edge = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(order)]))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if j - i > 1:
            out.append((text[i:j], offset[i:j]))
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


class Places:
    """Texts with the places where they stand: (block, id, tie, position)."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.of: list[int] = []
        self.at: list[np.ndarray] = []  # rows: block, id, tie, position

    def add(self, text: bytes, places: np.ndarray) -> None:
        k = self.number.setdefault(text, len(self.number))
        self.of.append(k)
        self.at.append(places)

    def grouped(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Texts; the text number of each place; places in ascending (text, id, tie, position)."""
        places = np.concatenate(self.at) if self.at else np.zeros((0, 4), np.int64)
        of = np.repeat(np.array(self.of, np.int64), [len(x) for x in self.at])
        order = np.lexsort((places[:, 3], places[:, 2], places[:, 1], of))
        return list(self.number), of[order], places[order]


def repeated(texts: list[bytes], of: np.ndarray, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Removed ranges (block, id, tie, start, end) among the places of contexts."""
    count = np.bincount(of, minlength=len(texts))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(np.append(0, [len(t) for t in texts[:-1]])).astype(np.int64)
    n_windows = np.array([len(t) - width + 1 for t in texts])
    window = np.repeat(starts, n_windows) + _within(n_windows)
    h = T.rolling_hash(T.prefix_hash(joined), width)[window]
    _, inverse = np.unique(h, return_inverse=True)
    again = np.bincount(inverse, weights=np.repeat(count, n_windows))[inverse] >= 2
    bounds = np.append(0, np.cumsum(n_windows))
    first_place = np.append(0, np.cumsum(count))
    cut = Places()
    for k, t in enumerate(texts):
        own = places[first_place[k] : first_place[k + 1]]
        for i, j in zip(*_runs(again[bounds[k] : bounds[k + 1]]), strict=True):
            cut.add(t[i : j + width - 1], own + np.array([0, 0, 0, i]))
    texts, of, places = cut.grouped()
    count = np.bincount(of, minlength=len(texts))
    first_place = np.append(0, np.cumsum(count))
    earliest = places[first_place[:-1]]  # of each text
    stays = [np.ones(len(t) - width + 1, bool) for t in texts]
    for batch in _batches(texts, width):
        for text, offset in equal_windows([texts[k] for k in batch], width):
            who = batch[text]
            at = earliest[who]
            best = np.lexsort((at[:, 3] + offset, at[:, 2], at[:, 1]))[0]
            for x, (k, o) in enumerate(zip(who.tolist(), offset.tolist(), strict=True)):
                if x != best:
                    stays[k][o] = False
    out = []
    for k, keep in enumerate(stays):
        own = places[first_place[k] : first_place[k + 1]]
        rest = own[1:]
        if len(rest):
            out.append(np.concatenate([rest, rest[:, 3:4] + len(texts[k])], axis=1))
        for i, j in zip(*_runs(~keep), strict=True):
            b, d, tie, p = own[0].tolist()
            out.append(np.array([[b, d, tie, p + i, p + j - 1 + width]]))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batches(texts: list[bytes], width: int, limit: int = SORT_BYTES) -> Iterator[np.ndarray]:
    """Numbers of texts that may share windows, in groups of about ``limit`` bytes.

    Texts are joined where a window hash links them, so equal windows are never apart. A
    text that is linked with no other is in no group.
    """
    if not texts:
        return
    n_windows = np.array([len(t) - width + 1 for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(np.append(0, [len(t) for t in texts[:-1]])).astype(np.int64)
    h = T.rolling_hash(T.prefix_hash(joined), width)[np.repeat(starts, n_windows) + _within(n_windows)]
    owner = np.repeat(np.arange(len(texts)), n_windows)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    link = np.flatnonzero(h[1:] == h[:-1])
    up = list(range(len(texts)))
    for a, b in zip(owner[link].tolist(), owner[link + 1].tolist(), strict=True):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        up[max(a, b)] = min(a, b)
    root = np.arange(len(texts))
    for k in range(len(texts)):
        root[k] = root[up[k]]  # up[k] <= k, so it is final
    order = np.argsort(root, kind="stable")
    order = order[np.bincount(root, minlength=len(texts))[root[order]] > 1]
    if not len(order):
        return
    sizes = np.array([len(t) + 1 for t in texts])[order]
    new = np.concatenate(([True], root[order][1:] != root[order][:-1]))
    begin, total = 0, 0
    for k in range(len(order)):
        if new[k] and total >= limit:
            yield order[begin:k]
            begin, total = k, 0
        total += int(sizes[k])
    yield order[begin:]


def _own_key(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(id, tie) of each row."""
    out = np.empty((len(offsets) - 1, 2), np.int64)
    out[:, 0] = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    for k in range(len(out)):
        out[k, 1] = int.from_bytes(hashlib.blake2b(buf[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), "little", signed=True)
    return out


_SENT = "shard long, block int, texts binary, sizes binary, places binary, digests binary"


def _planes(rows: np.ndarray) -> bytes:
    """Rows of numbers by byte planes, which compress where neighbours are alike."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _unplaned(blob: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` bytes."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1]))) if len(shard) else np.zeros(0, np.int64)
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=False):
        yield int(shard[order[i]]), order[i:j]


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Rows (id, tie, start, end) with touching ranges of one document joined."""
    if not len(ranges):
        return ranges
    r = ranges[np.lexsort((ranges[:, 2], ranges[:, 1], ranges[:, 0]))]
    other = np.concatenate(([True], (r[1:, :2] != r[:-1, :2]).any(axis=1)))
    begin = np.flatnonzero(other)
    out = []
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(r)], strict=True):
        top = np.maximum.accumulate(r[i:j, 3])
        new = np.flatnonzero(np.concatenate(([True], r[i + 1 : j, 2] > top[:-1])))
        own = r[i:j][new].copy()
        own[:, 3] = top[np.append(new[1:], j - i) - 1]
        out.append(own)
    return np.concatenate(out)


def find_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, int]:
    """Rows (k, block, t), removed ranges (block, ranges) of each block, and the number of blocks."""
    spark = bounded_batches(documents).sparkSession
    paths: list = []
    total = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    block, n_blocks = _blocks(documents, id_col, int(total))
    shards = 1 + int(total) // SHARD_BYTES
    rows = documents.select(F.col(id_col).cast("long").alias("k"), block.alias("block"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block_ = b.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = T.flat(b.column(1))
            out: list[list] = [[], [], []]
            for i, j in T.slices(offsets):
                h, _, _, row = contexts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, gram)
                of = block_[i:j][row] if len(row) else row
                for x in np.unique(of):
                    distinct, n = np.unique(h[of == x], return_counts=True)
                    shard = (distinct >> np.uint64(16)) % np.uint64(shards)
                    order = np.argsort(shard, kind="stable")
                    edges = np.searchsorted(shard[order], np.arange(shards + 1))
                    for s in np.flatnonzero(np.diff(edges)):
                        own = order[edges[s] : edges[s + 1]]
                        for c, v in zip(out, (int(s), int(x), distinct[own].tobytes() + np.minimum(n[own], 1 << 30).astype(np.uint32).tobytes()), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["shard", "block", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        n = [len(x) // 12 for x in blobs]
        h = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, n, strict=True)])
        c = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(blobs, n, strict=True)])
        of = np.repeat(table.column("block").to_numpy(), n)
        order = np.lexsort((of, h))
        h, c, of = h[order], c[order], of[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sums = np.add.reduceat(c.astype(np.int64), at)
        mine = np.repeat(sums, np.diff(np.append(at, len(h))))
        good = (mine >= 2) & np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
        out: list[list] = [[], []]
        for x in np.unique(of[good]):
            own = good & (of == x)
            out[0].append(int(x))
            out[1].append(h[own].tobytes() + (mine[own] > hot).astype(np.uint8).tobytes())
        return pa.table({"block": pa.array(out[0], pa.int32()), "keys": pa.array(out[1], pa.binary())})

    def gather(docs: pa.Table, known: pa.Table) -> pa.Table:
        blobs = known.column("keys").to_pylist()
        out: dict[str, list] = {x.split()[0]: [] for x in _SENT.split(", ")}
        if blobs and docs.num_rows:
            keys = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 9) for x in blobs])
            heat = np.concatenate([np.frombuffer(x, np.uint8, len(x) // 9, len(x) // 9 * 8) for x in blobs])
            order = np.argsort(keys)
            keys, heat = keys[order], heat[order]
            block_ = docs.column("block")[0].as_py()
            buf, offsets = T.flat(docs.column("t"))
            own_key = _own_key(docs.column("k").combine_chunks() if isinstance(docs.column("k"), pa.ChunkedArray) else docs.column("k"), buf, offsets)
            found: dict[bytes, tuple[int, int]] = {}  # earliest place of a context in the block: row, position
            shard_of: dict[bytes, int] = {}
            heated: dict[bytes, tuple[int, int]] = {}  # the same of a window of a hot anchor
            gone: list[tuple[int, int, int]] = []  # later places: row, start, end
            rank = np.lexsort((own_key[:, 1], own_key[:, 0]))
            # a row that repeats both id and text is no second document
            fresh = np.ones(len(own_key), bool)
            fresh[rank[1:]] = (own_key[rank[1:]] != own_key[rank[:-1]]).any(axis=1)
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))  # rows in the order of documents
            nth, row_at = place.tolist(), rank.tolist()

            def meet(seen: dict, text: bytes, r: int, p: int) -> None:
                here = (nth[r], p)
                old = seen.get(text)
                if old is None or here < old:
                    seen[text] = here
                    here = old
                if here is not None:
                    gone.append((row_at[here[0]], here[1], here[1] + len(text)))

            for i, j in T.slices(offsets):
                part = buf[offsets[i] : offsets[j]]
                off = offsets[i : j + 1] - offsets[i]
                h, first, last, row = contexts(part, off, width, gram)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                good = (keys[at] == h) & fresh[i:j][row] if len(row) else np.zeros(0, bool)
                raw = part.tobytes()
                warm = heat[at[good]] > 0
                to = ((h[good] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64).tolist()
                start = (first - off[row])[good].tolist()
                for s, a, z, r, p, w in zip(to, first[good].tolist(), last[good].tolist(), row[good].tolist(), start, warm.tolist(), strict=True):
                    if w:
                        for k in range(z - a + 1):
                            meet(heated, raw[a + k : a + k + width], i + r, p + k)
                    else:
                        t = raw[a : z + width]
                        shard_of[t] = s
                        meet(found, t, i + r, p)

            def rows_of(places: list[tuple[int, int]]) -> np.ndarray:
                pair = np.array(places, np.int64).reshape(-1, 2)
                return np.concatenate([own_key[rank[pair[:, 0]]], pair[:, 1:]], axis=1)

            def emit(shard: int, **columns: bytes) -> None:
                for c, x in out.items():
                    x.append({"shard": shard, "block": block_}.get(c, columns.get(c)))

            texts, at_ = list(found), rows_of(list(found.values()))
            for s, own in _by_shard(np.array([shard_of[t] for t in texts], np.int64)):
                emit(s, texts=b"".join(texts[k] for k in own), sizes=np.array([len(texts[k]) for k in own], np.int32).tobytes(), places=_planes(at_[own]))
            # in reading order, so that the places' planes compress
            at_ = rows_of(list(heated.values()))
            digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16, key=b"window").digest() for t in heated), np.uint8).reshape(-1, 16)
            for s, own in _by_shard((digests[:, :8].copy().view(np.uint64).ravel() % np.uint64(shards)).astype(np.int64)):
                emit(s, places=_planes(at_[own]), digests=_planes(digests[own]))
            late = np.array(gone, np.int64).reshape(-1, 3)
            late = _merged(np.concatenate([own_key[late[:, 0]], late[:, 1:]], axis=1))
            if len(late):
                emit(-1 - block_, places=_planes(late))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    def decide(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:  # settled inside its block
            ranges = [_unplaned(x, 32).tobytes() for x in table.column("places").to_pylist()]
            return pa.table({"block": table.column("block"), "ranges": pa.array(ranges, pa.binary())})
        all_ = Places()
        hot: list[tuple[np.ndarray, np.ndarray]] = []
        for block_, raw, sizes, where, digests in zip(*(table.column(c).to_pylist() for c in ("block", "texts", "sizes", "places", "digests")), strict=True):
            at = _unplaned(where, 24).view(np.int64)
            at = np.concatenate([np.full((len(at), 1), block_), at], axis=1)
            if digests is not None:
                hot.append((_unplaned(digests, 16).view(np.uint64), at))
                continue
            begin = 0
            for k, n in enumerate(np.frombuffer(sizes, np.int32).tolist()):
                all_.add(raw[begin : begin + n], at[k : k + 1])
                begin += n
        got = repeated(*all_.grouped(), width) if all_.of else np.zeros((0, 5), np.int64)
        if hot:
            digest, at = (np.concatenate(x) for x in zip(*hot, strict=True))
            order = np.lexsort((at[:, 3], at[:, 2], at[:, 1], digest[:, 1], digest[:, 0]))
            digest, at = digest[order], at[order]
            later = np.concatenate(([False], (digest[1:] == digest[:-1]).all(axis=1)))
            got = np.concatenate([got, np.concatenate([at[later], at[later][:, 3:] + width], axis=1)])
        blocks, ranges = [], []
        for b, own in _by_shard(got[:, 0]):
            blocks.append(b)
            ranges.append(_merged(got[own, 1:]).tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "ranges": pa.array(ranges, pa.binary())})

    sent = rows.select("block", "t").mapInArrow(count, "shard long, block int, blob binary")
    keys = stored(dealt(sent, "shard", shards).groupBy("shard").applyInArrow(answer, "block int, keys binary"), paths)
    sides = [dealt(x, "block", n_blocks).groupBy("block") for x in (rows, keys)]
    moved = sides[0].cogroup(sides[1]).applyInArrow(gather, _SENT)
    ranges = stored(dealt(moved, "shard", shards).groupBy("shard").applyInArrow(decide, "block int, ranges binary"))
    drop(spark, paths)
    return rows, ranges, n_blocks


def _kept(docs: pa.Table, ranges: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, bytes, and starts and ends of the maximal removed runs of each row."""
    blobs = ranges.column("ranges").to_pylist()
    cut = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in blobs]) if blobs else np.zeros((0, 4), np.int64)
    cut = cut[np.lexsort((cut[:, 2], cut[:, 1], cut[:, 0]))]
    edge = np.flatnonzero(np.concatenate(([True], (cut[1:, 0] != cut[:-1, 0]) | (cut[1:, 1] != cut[:-1, 1])))) if len(cut) else np.zeros(0, np.int64)
    of = {(int(cut[i, 0]), int(cut[i, 1])): (i, j) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(cut)], strict=False)}
    buf, offsets = T.flat(docs.column("t"))
    ids = docs.column("k")
    keys = _own_key(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, buf, offsets)
    for k in range(len(keys)):
        i, j = of.get((int(keys[k, 0]), int(keys[k, 1])), (0, 0))
        text = buf[offsets[k] : offsets[k + 1]]
        if i == j:
            yield k, text, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        a, z = cut[i:j, 2], np.maximum.accumulate(cut[i:j, 3])
        new = np.flatnonzero(np.concatenate(([True], a[1:] > z[:-1])))
        yield k, text, a[new], z[np.append(new[1:], len(a)) - 1]


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, texts: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) per row.

    kept: the remaining bytes (null without ``texts``); spans: array of [start, end) byte
    ranges that were removed.
    """
    rows, ranges, n_blocks = find_repeats(documents, id_col, text_col, width, gram, hot)

    def finish(docs: pa.Table, cut: pa.Table) -> pa.Table:
        n, removed, spans, digest, kept, listed = [], [], [], [], [], []
        for _, text, a, z in _kept(docs, cut):
            left = b"".join(text[i:j].tobytes() for i, j in zip([0, *z.tolist()], [*a.tolist(), len(text)], strict=True))
            n.append(len(text))
            removed.append(int((z - a).sum()))
            spans.append(len(a))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left if texts else None)
            listed.append([{"start": i, "end": j} for i, j in zip(a.tolist(), z.tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"k": docs.column("k"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(listed, span)})

    schema = S.StructType([rows.schema["k"], *S.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")])
    sides = [dealt(x, "block", n_blocks).groupBy("block") for x in (rows, ranges)]
    return sides[0].cogroup(sides[1]).applyInArrow(finish, schema).withColumnRenamed("k", id_col)
