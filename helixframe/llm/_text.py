"""Vectorised byte, word and hash helpers that the Arrow functions share.

All work on one flat ``uint8`` buffer with row offsets, so a batch of texts is
handled by a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are handled in slices of about this many bytes.
SLICE_BYTES = 2 << 20

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for rolling_hash()."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * _power_table(_BASE, len(buf)), out=out[1:])
    return out


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings and, for each span, the number of its own.

    Spans are ascending and disjoint. Strings are told apart by their bytes, not by a hash.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    # spans and the gaps between them are one array over the buffer, without a copy
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    data = pa.py_buffer(np.ascontiguousarray(buf))
    both = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), data]).dictionary_encode()
    number = both.indices.to_numpy()[::2]
    used = np.zeros(len(both.dictionary), bool)
    used[number] = True
    place = np.cumsum(used) - 1
    return both.dictionary.take(pa.array(np.flatnonzero(used))).to_pylist(), place[number].astype(np.int64)


#: Longest span that is hashed by eight bytes at a time.
_SHORT = 64


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes.

    Eight bytes at a time are mixed into the value; up to eight bytes of one length never
    collide. Spans above ``_SHORT`` bytes get a keyed cryptographic hash. Without a ``key``
    longer spans can be written to collide. With one, that is drawn anew for each call, the
    value that each block meets is secret, so they cannot.
    """
    size = ends - starts
    secret = None if key is None else np.frombuffer(blake2b(key, digest_size=32, person=b"spans").digest(), "<u8")
    h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + (U64(0x2545F4914F6CDD1D) if secret is None else secret[0]))
    if not len(starts):
        return h
    by = U64(0x9FB21C651E98DF25) if secret is None else secret[1] | U64(1)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    own, at, left = slice(None), starts, size
    for k in range(_SHORT // 8):
        if k:
            own = np.flatnonzero((size > 8 * k) & (size <= _SHORT))
            if not len(own):
                break
            at, left = starts[own] + 8 * k, size[own] - 8 * k
        chunk = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.clip(left, 1, 8)) * 8).astype(U64))
        x = mix((h[own] * by if k else h) ^ chunk)
        h[own] = x if secret is None else mix(x + secret[2])
    for k in np.flatnonzero(size > _SHORT).tolist():
        digest = blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, key=key or b"span").digest()
        h[k] = int.from_bytes(digest, "little")
    return h


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Unmixed polynomial hash of every ``width``-byte string of the buffer.

    Different strings can be written to collide, so equal hashes prove nothing by themselves.
    """
    n = len(prefix) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return (prefix[width:] - prefix[:n]) * _power_table(_INVERSE, n)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one longer row makes a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: All bytes but space and \t \n \v \f \r.
NOT_BLANK = ~class_table(b" \t\n\v\f\r")
#: Digits, a-z and every byte of a non-ASCII character (texts are lower-cased first).
ALNUM = class_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of bytes in ``inside``; runs end with their row."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[buf]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    np.logical_not(m[:-1], out=first[1:])
    np.logical_not(m[1:], out=last[:-1])
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = True
    last[cut - 1] = True
    starts = np.flatnonzero(m & first)
    ends = np.flatnonzero(m & last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets into a list sorted by row."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def combine(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive items."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, width, dtype=U64)
    for k in range(width):
        out = out * U64(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(out)
