"""Near-duplicates by SetSketch registers, banding, joint likelihood and an exact check.

A document's set is its distinct five-word shingles (texts of fewer words: the whole
sequence; no words: empty and linked with nothing). The steps:

1. One row of sketch per document: register i is floor(1 - log_b(x)) of the least of
   exponentially distributed hashes x of the shingles, truncated to [0, 65535].
   Documents with equal sets form a class at once; its smallest id stands for it.
2. Bands of registers are hashed. A task gathers ``FLUSH_KEYS`` of them, links the members of
   a bucket to the smallest id among them and hands only that id on, so a bucket that holds a
   third of all rows reaches the next task as one key for each gathering.
3. Each candidate is paired with the leader it shares most bands with. Pairs whose joint
   maximum-likelihood estimate of the similarity is ``SIGMAS`` standard errors below the
   threshold drop out, the others are verified on full sets. Verified links are closed to
   components.
4. Candidate groups that still hold several components are compared further: members
   outside the group's main component, in blocks, against the group's members in
   blocks. A task skips pairs that are connected already, and by the likelihood those that
   are as far below the threshold; the others are verified there on full sets. So no link
   between different texts is lost but by the chance of the bands (below 1e-6 for a pair at
   the threshold) and of the estimate (5 standard errors).

Ids must be whole numbers. Rows with a null id have a set but take no part in links: their
component is null and they are kept. Rows that share an id are one node, whose set is that
with the least digest. Null and empty texts have no set and are kept. An empty table gives
no rows; other columns, whatever their names, are ignored. A very long text is held whole
in one task, with about 40 bytes for each of its words beside it.

Every join sorts and merges: tables of ids and digests are small as compressed files, so Spark
would send one after the other through the driver to broadcast them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded_batches, dealt, drop, stored
from .components import components

WORDS = 5
#: Links need 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
BASE = 1.01
RATE = 20.0
BANDS, ROWS = 40, 4
#: Band keys that meet in one task of step 2.
SHARD_KEYS = 400_000
#: Band keys that a task of step 2 gathers before it deals them to shards.
FLUSH_KEYS = 2_000_000
#: Documents and shingles in a block of step 4; salts of a candidate group.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
SALTS = 32
SIGMAS = 5.0
_TOP = 65535


def _seeds(n: int) -> np.ndarray:
    return T.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, key: bytes, width: int = WORDS) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Sorted distinct shingle hashes of each row, and a digest of the set.

    The digest of a set of one shingle has that shingle's words, so that short texts are told
    apart by 128 bits as long ones are.
    """
    low = T.lower_ascii(buf)
    starts, ends, row = T.words(low, offsets, T.NOT_BLANK)
    n_rows = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n_rows, [None] * n_rows
    h = T.span_hash(low, starts, ends, key)
    bounds = T.row_bounds(row, n_rows)
    all_ = T.combine(h, width)
    out, digests = [], []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= width:
            s = np.sort(all_[i : j - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(T.combine(h[i:j], j - i) if j > i else np.zeros(0, np.uint64))
        words = b" ".join([low[starts[k] : ends[k]].tobytes() for k in range(i, min(j, i + width))]) if len(out[-1]) == 1 else b""
        digests.append(hashlib.blake2b(out[-1].tobytes() + words, digest_size=16, key=key).digest() if j > i else None)
    return out, digests


def registers(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row for each set."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    seeds = _seeds(n)
    least = np.empty((n, len(sets)), np.uint32)
    for i in range(n):
        v = low * seeds[2 * i]
        v += high * seeds[2 * i + 1]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least[i] = np.minimum.reduceat(v, at)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 32768 // 2, 0, _TOP).astype(np.uint16).T.copy()


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    r = regs.astype(np.uint64).reshape(len(regs), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(regs), bands)).copy()
    for k in range(rows):
        out = out * np.uint64(0x9FB21C651E98DF25) + r[:, :, k]
    return T.mix(out)


def _log_likelihood(above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def _compared(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> tuple:
    above, below = (first > second).sum(axis=1), (first < second).sum(axis=1)
    u = n_first / (n_first + n_second)
    return above, below, first.shape[1] - above - below, u, np.minimum(u / (1 - u), (1 - u) / u)


def estimate(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of pairs of sketches.

    The likelihood has the numbers of registers that are larger, equal and smaller;
    p(x) = -log_b(1 - x (b-1)/b) is the chance that a register of one set exceeds the
    other's when x is that set's share outside the other.
    """
    above, below, equal, u, most = (x[:, None] for x in _compared(first, second, n_first, n_second))
    grid = np.linspace(0, 1, 201)
    return grid[_log_likelihood(above, below, equal, u, np.minimum(grid[None, :], most)).argmax(axis=1)]


def at_least(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, j: float) -> np.ndarray:
    """Whether the estimate is ``j`` or more: the likelihood has one peak, so its slope at j tells."""
    above, below, equal, u, most = _compared(first, second, n_first, n_second)
    rising = _log_likelihood(above, below, equal, u, np.minimum(j + 0.002, most)) >= _log_likelihood(above, below, equal, u, np.minimum(j, most))
    return rising & (most >= j)


def _sketched(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column(1))
            n, digest, sketch = [], [], []
            for i, j in T.slices(offsets):
                sets, own = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key)
                digest += own
                full = [s for s in sets if len(s)]
                regs = iter(registers(full)) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    sketch.append(next(regs).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["id", "n_shingles", "digest", "sketch"])

    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, sketch binary")


def _leaders(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least id of each; the other ids, each with its key's least."""
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    leader = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = who != leader
    return keys[new], who[new], who[other], leader[other]


def _dealt_keys(keys: np.ndarray, who: np.ndarray, shards: int) -> pa.RecordBatch:
    """(shard, blob) rows of the shards that occur, however many there are."""
    to = (keys >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0)))
    blobs = [np.stack([keys[own].view(np.int64), who[own]]).tobytes() for own in np.split(order, first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(to[order[first]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _buckets(sketches: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): band keys of ``FLUSH_KEYS`` at a time with their leader; and their inner links (shard -1).

    A task gathers keys before it deals them, so that a row holds several even where there are many shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, who, member, leader = _leaders(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k in range(0, len(member), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.stack([member[k : k + 100_000], leader[k : k + 100_000]]).tobytes()], pa.binary())], names=["shard", "blob"])
            yield _dealt_keys(keys, who, shards)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(ids), -1)
            held.append((band_keys(regs).ravel(), np.repeat(ids, BANDS)))
            size += len(ids) * BANDS
            if size >= FLUSH_KEYS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return sketches.select("id", "sketch").mapInArrow(run, "shard long, blob binary")


def _pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs]
    return (np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])) if both else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(a)))
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(n)], names=["a", "b", "n"])


def _star_links(buckets: DataFrame, shards: int) -> DataFrame:
    """(a, b, n): candidate links of members to leaders, with the number of bands."""

    def merge(table: pa.Table) -> pa.Table:
        keys, who = _pairs(table.column("blob").to_pylist())
        return pa.Table.from_batches([_counted(*_leaders(keys.view(np.uint64), who)[2:])])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _counted(*_pairs(b.column(0).to_pylist()))

    across = dealt(buckets.where("shard >= 0"), "shard", shards).groupBy("shard").applyInArrow(merge, "a long, b long, n long")
    within = buckets.where("shard < 0").select("blob").mapInArrow(inner, "a long, b long, n long")
    return across.union(within).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _full_sets(documents: DataFrame, wanted: DataFrame, reps: DataFrame, key: bytes) -> DataFrame:
    """(id, shingles): the sets of the wanted ids as packed hashes, one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column(1))
            out: list[bytes] = []
            digest: list[bytes | None] = []
            for i, j in T.slices(offsets):
                sets, own = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key)
                out += [s.tobytes() for s in sets]
                digest += own
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], names=["id", "digest", "shingles"])

    # one plan at every size: the texts are dealt by id, however few ids are wanted
    found = documents.join(wanted.hint("merge"), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, digest binary, shingles binary")
    return found.join(reps.select("id", "digest").hint("merge"), ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")


def linked(first: np.ndarray, second: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |A & B| >= percent * |A | B| for sorted distinct hashes."""
    if len(first) > len(second):
        first, second = second, first
    if not len(first) or 100 * len(first) < percent * len(second):
        return False
    if len(second) == 1:  # sets of different digests: two shingles, whatever their hashes
        return False
    both = int((second[np.minimum(np.searchsorted(second, first), len(second) - 1)] == first).sum())
    return 100 * both >= percent * (len(first) + len(second) - both)


def _least(n: int) -> float:
    """The estimate from ``n`` registers below which a pair is surely under the threshold."""
    t = PERCENT / 100
    return t - SIGMAS * (t * (1 - t) / n) ** 0.5


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimated similarity does not exclude a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = [b.column(k).to_numpy().astype(float) for k in (2, 3)]
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (4, 5)]
            good = estimate(*regs, *n) >= _least(regs[0].shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good))

    sides = [reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge") for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open_members(members: DataFrame, paths: list) -> DataFrame:
    """(grp, id, outside, comp, n_shingles, block, blocks) of groups that hold several components.

    members: grp, id, comp, n_shingles. The component with most members is the group's main
    one. Rows meet their group's figures by (grp, salt), as one group may hold a third of all.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(SALTS)).cast("int"))
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    figures = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n_all"), F.sum("shingles").alias("shingles"), F.count("*").alias("comps")).where("comps > 1")
    blocks = F.ceil(F.greatest(F.col("n_all") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    known = salted.select("grp", "salt").distinct().join(figures.hint("merge"), "grp").select("grp", "salt", "main", blocks.alias("blocks"))
    placed = salted.join(known.hint("merge"), ["grp", "salt"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return stored(placed.select("grp", "id", (F.col("comp") != F.col("main")).alias("outside"), "comp", "n_shingles", "block", "blocks"), paths)


def _more_links(placed: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a candidate group of _open_members().

    Only pairs with a member outside the main component are looked at, as (block of those) x
    (block of all). Sketches and sets are joined by id, when the rows know their tasks. A
    task skips pairs that are connected already, by then, and pairs whose estimate is
    clearly below the threshold, compares the full sets of the others, and returns only the
    links that joined components: no pair becomes a row.
    """
    asking = placed.where("outside").select("grp", F.col("block").alias("qb"), "blocks").distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.where("outside").select("grp", F.col("block").alias("qb"), every.alias("ab"), "id", "comp", F.lit(True).alias("asks"))
    asked = asking.groupBy("grp").agg(F.collect_set("qb").alias("qbs"))  # one number for each block of a group
    salt = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(SALTS)).cast("int")
    salted = placed.withColumn("salt", salt)
    known = salted.select("grp", "salt").distinct().join(asked.hint("merge"), "grp")
    right = salted.join(known.hint("merge"), ["grp", "salt"]).select("grp", F.explode("qbs").alias("qb"), F.col("block").alias("ab"), "id", "comp", F.lit(False).alias("asks"))
    sides = left.union(right).join(reps.select("id", "n_shingles", "sketch").hint("merge"), "id").join(sets.hint("merge"), "id")
    sides = sides.select("grp", "qb", "ab", "id", "comp", "n_shingles", "sketch", "shingles", "asks")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        x, y = table.filter(asks), table.filter(pc.invert(asks))
        a, b = [], []
        if x.num_rows and y.num_rows:
            ids, comps, sizes_ = (y.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
            regs = np.frombuffer(b"".join(y.column("sketch").to_pylist()), np.uint16).reshape(len(ids), -1)
            full = [np.frombuffer(s, np.uint64) for s in y.column("shingles").to_pylist()]
            label = comps.copy()
            of = {int(c): int(c) for c in comps}  # where an asking member's component stands now
            least = _least(regs.shape[1])
            for i, c, n, r, s in zip(*(x.column(k).to_pylist() for k in ("id", "comp", "n_shingles", "sketch", "shingles")), strict=True):
                own = of.get(c, c)
                near = np.flatnonzero((label != own) & (100 * np.minimum(sizes_, n) >= PERCENT * np.maximum(sizes_, n)))
                if not len(near):
                    continue
                mine, set_ = np.frombuffer(r, np.uint16), np.frombuffer(s, np.uint64)
                near = near[at_least(mine[None, :], regs[near], np.full(len(near), float(n)), sizes_[near].astype(float), least)]
                near = near[np.argsort(-(regs[near] == mine).sum(axis=1), kind="stable")]
                for k in near.tolist():
                    if label[k] != own and linked(set_, full[k]):
                        a.append(i)
                        b.append(int(ids[k]))
                        gone = label[k]
                        label[label == gone] = own
                        for q, v in of.items():
                            if v == gone:
                                of[q] = own
                        of[c] = own
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sides.groupBy("grp", "qb", "ab").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (least id reachable by links), kept (is that id)."""
    spark = documents.sparkSession
    paths: list = []
    key = secrets.token_bytes(16)  # for the hashes of words: nobody can write texts that collide
    rows = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(_sketched(rows, key), paths)
    one = sketches.where("id is not null and digest is not null").groupBy("id").agg(F.min("digest").alias("digest"))
    classes = one.groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = stored(one.join(classes.hint("merge"), "digest").select("id", "rep", "digest"), paths)
    reps = stored(sketches.join(nodes.where("id = rep").select("id", "digest").hint("merge"), ["id", "digest"]).dropDuplicates(["id"]), paths)
    n = reps.count()
    shards = shards or max(8, -(-n * BANDS // SHARD_KEYS))
    stars = stored(_star_links(_buckets(reps, shards), shards), paths)
    sets = stored(_full_sets(rows, stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), reps, key), paths)
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    good = stored(_verified(_likely(best, reps), sets), paths)

    groups = components(stars, keep=paths)
    comps = components(good, keep=paths)
    members = groups.select(F.col("node").alias("id"), F.col("component").alias("grp")).join(comps.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    members = members.join(reps.select("id", "n_shingles").hint("merge"), "id").select("grp", "id", F.coalesce("component", "id").alias("comp"), "n_shingles")
    more = stored(_more_links(_open_members(members, paths), reps, sets), paths)
    final = components(good.union(more), keep=paths).select(F.col("node").alias("rep"), "component")
    placed = nodes.join(final.hint("merge"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n_shingles").join(placed.hint("merge"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    out = stored(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")))
    drop(spark, paths)
    return out


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each group: its smallest id; all columns stay.

    Rows that repeat an id count as one document, of which the row with the least digest of
    its text stays. Rows with a null id all stay.
    """
    found = near_duplicates(documents, id_col, text_col)
    gone = found.where("not kept").select(id_col).distinct()
    kept = documents.join(gone.hint("merge"), id_col, "left_anti").select(*documents.columns)
    # most tables repeat no id: texts are then not shuffled for it
    twice = stored(documents.groupBy(F.col(id_col)).agg(F.count("*").alias("__n")).where("__n > 1").where(F.col(id_col).isNotNull()).select(id_col))
    if twice.isEmpty():
        return kept
    first = Window.partitionBy(F.col(id_col)).orderBy(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    again = kept.join(twice.hint("merge"), id_col, "left_semi").select(*documents.columns).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.join(twice.hint("merge"), id_col, "left_anti").select(*documents.columns).union(again)
