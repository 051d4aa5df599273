"""Variable-capacity best-fit packing of token counts into training sequences.

Several sequence lengths are permitted, each with a cost. Items go longest first into
the fullest open bin that still takes them. If none does, a new bin is opened, and its size
is chosen jointly with the items to come: each permitted size is filled ahead with the
longest remaining items that fit, and the size whose contents cost least per token is
opened. One plan is made for each largest size, every bin of a plan is downsized to the
smallest size that holds its contents, and the plan of least total cost is kept.

Texts longer than the largest size are split: whole pieces of that size fill a bin of
their own, the rest is packed. Nothing is dropped: texts of no tokens (null, empty) get one
row with no bin. Bins never mix shards; a shard holds about ``SHARD_ITEMS`` rows by a hash
of the row and its place in the stored table of lengths, so memory is bounded, hot ids
spread, and a task that runs again sees the same rows. Null ids and repeated rows are
packed like others; ties of length go by id and piece; other columns, whatever their names,
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored, with_columns

SIZES = (512, 1024, 2048, 4096)
SHARD_ITEMS = 50_000


def default_cost(size: int) -> float:
    """Linear work, the quadratic part of attention, and a fixed part for each sequence."""
    return 16 + size + size * size / 32768


def _ahead(n: int, size: int, left: int, count: list[int]) -> int:
    """Tokens of a bin of ``size`` that holds ``n`` and then the longest remaining items that fit.

    Bit k of ``left`` is set where items of length k remain, ``count[k]`` of them.
    """
    room = size - n
    while room and (fits := left & ((2 << room) - 1)):
        k = fits.bit_length() - 1
        room -= k * min(count[k], room // k)
        left &= (1 << k) - 1
    return size - room


def _plan(lengths: list[int], sizes: list[int], cost: dict[int, float], largest: int) -> tuple[list[int], list[int], list[int], float]:
    """Bin and offset of each item (longest first), contents of each bin, cost after downsizing."""
    offered = [s for s in sizes if s <= largest]
    count = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    left = sum(1 << k for k, c in enumerate(count) if c and k)
    held_by = [0] * (sizes[-1] + 1)  # smallest size for each number of tokens
    at = 0
    for u in range(1, sizes[-1] + 1):
        at += u > sizes[at]
        held_by[u] = sizes[at]
    bins_of: dict[int, list[int]] = {}
    free = 0  # bit r is set where an open bin has r tokens left
    used: list[int] = []
    room: list[int] = []
    where, offset = [], []
    for n in lengths:
        count[n] -= 1
        if not count[n]:
            left &= ~(1 << n)
        fits = free >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = bins_of[r].pop()
            if not bins_of[r]:
                free &= ~(1 << r)
        else:
            best = None
            for s in [s for s in offered if s >= n] or [held_by[n]]:
                u = _ahead(n, s, left, count)
                price = (cost[held_by[u]] / u, s)
                if best is None or price < best:
                    best = price
            b = len(used)
            used.append(0)
            room.append(best[1])
        where.append(b)
        offset.append(used[b])
        used[b] += n
        room[b] -= n
        if room[b]:
            bins_of.setdefault(room[b], []).append(b)
            free |= 1 << room[b]
    return where, offset, used, sum(cost[held_by[u]] for u in used)


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, cost=default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin and final bin size of each item (0 < length <= max(sizes))."""
    allowed = sorted(set(sizes))
    prices = {s: cost(s) for s in allowed}
    order = np.argsort(-lengths, kind="stable")
    items = lengths[order].tolist()
    where, offset, used, _ = min((_plan(items, allowed, prices, s) for s in allowed), key=lambda p: p[3])
    final = np.array(allowed)[np.searchsorted(allowed, used)] if used else np.zeros(0, np.int64)
    out = [np.zeros(len(lengths), np.int64) for _ in range(3)]
    for x, v in zip(out, (where, offset, final[where] if used else []), strict=True):
        x[order] = v
    return out[0], out[1], out[2]


def word_tokens(text: Column) -> Column:
    """Words between ASCII blanks and one end mark; null and empty texts have none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def pack_lengths(items: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", length_col: str = "n_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(id_col, piece, first_token, n_tokens, bin_id, bin_size, bin_offset): where every piece goes.

    bin_id is shard * 2**32 + number; n_tokens 0 gives one row with bin_id null.
    """
    top = max(sizes)
    rows = stored(items.select(F.col(id_col).alias("k"), F.greatest(F.col(length_col).cast("long"), F.lit(0)).alias("n")))
    shards = 1 + rows.count() // shard_items
    pieces = F.when(F.col("n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / top) - 1))
    cut = rows.select("k", "n", F.explode(pieces).alias("piece"))
    cut = cut.select("k", F.col("piece"), (F.col("piece") * top).alias("first_token"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("n_tokens"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("k", "piece", F.monotonically_increasing_id() % 64), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        # one order for a shard, however its rows arrive
        table = table.sort_by([("n_tokens", "descending"), ("k", "ascending"), ("piece", "ascending")])
        n = table.column("n_tokens").to_numpy()
        shard = table.column("shard")[0].as_py()
        real = n > 0
        no, offset, size = pack(n[real], sizes)
        out = [np.zeros(len(n), np.int64) for _ in range(3)]
        for x, v in zip(out, (no + (shard << 32), size, offset), strict=True):
            x[real] = v
        columns = [pa.array(x, mask=~real) for x in out]
        return pa.Table.from_arrays([*(table.column(c) for c in ("k", "piece", "first_token", "n_tokens")), *columns], names=["k", "piece", "first_token", "n_tokens", "bin_id", "bin_size", "bin_offset"])

    packed = cut.groupBy("shard").applyInArrow(run, with_columns(cut.drop("shard"), "bin_id long, bin_size long, bin_offset long"))
    return packed.withColumnRenamed("k", id_col)


def best_fit(documents: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pack_lengths() of the word tokens of each text."""
    return pack_lengths(documents.select(F.col(id_col), word_tokens(F.col(text_col)).alias("__n")), sizes, id_col, "__n", shard_items)
