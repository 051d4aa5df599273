"""The trie of conversation prefixes, by a table of minimal-perfect-hash slots for each shard.

1. Turns are sorted by ranges of (conversation, turn), so a long conversation spans tasks.
   A prefix of d turns has the digest (d, sum of t_j B^j for j <= d) over two prime-field
   lanes, where t_j is a keyed 128-bit hash of a turn's role and text; keys and bases are drawn anew for
   each call. Sums of a task's part continue those of the parts before, of which there are
   at most two a task.
2. A rebuilt conversation is the head of one and the tail of another. Its digests follow
   from those of the two by a difference and a power of B.
3. Digests are counted by a grouped aggregation, which also proves that a digest stands for
   one turn after one prefix.
4. A node is owned by its smallest member. Nodes of one owner with equally many members
   are a stretch without branches; a stretch is a chain, and one slot.
5. Shards are the subtrees below the nodes with more than ``limit`` members (at least the
   square root of the number of turns). So a shard has a bounded number of chains however hot a first turn is, and
   there are no more such heavy nodes than turns / limit; those make one more shard, and their
   digests are what is broadcast.
6. In a shard, a SlotTable places the digests of the chains' last nodes. Counts are scattered into flat
   arrays by slot, the parents' digests are looked up to an array of parent slots, and leaves and saved
   tokens are added to parents by descending depth.

Conversations are those with a turn; turns of a null conversation id are left out. Turns are ordered by turn
(null first), role and text; a null role or text is empty; repeated rows are turns of their own.
An empty table gives no rows, not even a root. Other columns, whatever their names, are ignored.
A turn's text is held whole in one task.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, drop, stored
from .slots import SlotTable

P = (1 << 61) - 1
#: Turns sorted in one task; turns of a bucket of a conversation; chains of a shard.
TASK_TURNS, BUCKET, SHARD_CHAINS = 50_000, 4_096, 100_000
LEAST_LIMIT = 1_000
#: Most turns that a rebuilt conversation takes from another.
MOST_HEAD = 3
_M32, _M29 = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of arrays below it, by 32-bit halves."""
    u = np.uint64
    a, b = np.asarray(a).astype(u), np.asarray(b).astype(u)
    ah, al, bh, bl = a >> u(32), a & _M32, b >> u(32), b & _M32
    low, mid, high = al * bl, ah * bl + al * bh, ah * bh
    # 2**64 = 8 and 2**61 = 1 in the field; mid counts 2**32
    total = (low & u(P)) + (low >> u(61)) + (mid >> u(29)) + ((mid & _M29) << u(32)) + (high << u(3))
    total = (total & u(P)) + (total >> u(61))
    return np.where(total >= u(P), total - u(P), total).astype(np.int64)


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo 2**61 - 1."""
    u = np.uint64
    low, high = np.cumsum(x.astype(u) & _M32), np.cumsum(x.astype(u) >> u(32))
    high = high % u(P)
    return addmod(mulmod(high, np.full(len(x), 1 << 32)), (low % u(P)).astype(np.int64))


def addmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    return np.where(out >= P, out - P, out)


def submod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a - b + P)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), by doubling."""
    out = np.ones(max(n, 1), np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = mulmod(out[:more], np.full(more, pow(base, have, P)))
        have += more
    return out[:n]


@dataclass(frozen=True)
class Digester:
    """Key of the turns' hashes and the two bases of the prefixes' sums."""

    key: bytes
    bases: tuple[int, int]

    @staticmethod
    def new() -> Digester:
        return Digester(secrets.token_bytes(16), (secrets.randbelow(P - 2) + 2, secrets.randbelow(P - 2) + 2))

    def turn(self, role: str, text: str) -> tuple[int, int, int]:
        """Two field elements and 64 more bits of a turn's hash."""
        head = role.encode()
        raw = blake2b(len(head).to_bytes(8, "little") + head + text.encode(), digest_size=24, key=self.key).digest()
        a, b, c = (int.from_bytes(raw[k : k + 8], "little") for k in (0, 8, 16))
        return a % P, b % P, c - (1 << 63)


def _local(turns: DataFrame, tasks: int, d: Digester) -> DataFrame:
    """(conv, part, i, s1, s2, u1, u2, t, w, ws): turns numbered within their part of a conversation.

    i from 1; u: t B^i by lanes; s: their sums; t: a check; w: words; ws: their sums.
    """
    key = ["conv", "turn", "role", "text", "__row"]
    sorted_ = turns.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(tasks, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, i0, carry, words0 = None, 0, [0, 0], 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            hashes = [d.turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            w = np.array([len(t.encode().split()) for t in b.column(3).to_pylist()], np.int64)
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
            goes_on = conv[0] == last
            i = np.arange(len(conv)) - first[group] + 1
            if goes_on:
                i[group == 0] += i0
            us, ss = [], []
            for lane in range(2):
                t = np.array([h[lane] for h in hashes], np.int64)
                longest = int(np.where(group == 0, 0, i).max(initial=0)) + 1
                power = powers(d.bases[lane], max(longest, int((group == 0).sum())) + 1)
                rel = np.where(group == 0, i - (i0 if goes_on else 0), i)
                u = mulmod(t, power[rel])
                if goes_on:
                    mine = group == 0
                    u[mine] = mulmod(u[mine], np.full(int(mine.sum()), pow(d.bases[lane], i0, P)))
                s = sums(u)
                before = np.concatenate(([0], s))[first][group]
                s = submod(s, before)
                if goes_on:
                    s[group == 0] = addmod(s[group == 0], np.full(int((group == 0).sum()), carry[lane]))
                us.append(u)
                ss.append(s)
            ws = np.cumsum(w)
            ws = ws - np.concatenate(([0], ws))[first][group]
            if goes_on:
                ws[group == 0] += words0
            last, i0, carry, words0 = conv[-1], int(i[-1]), [int(ss[0][-1]), int(ss[1][-1])], int(ws[-1])
            columns = [conv, np.full(len(conv), part), i, *ss, *us, np.array([h[2] for h in hashes], np.int64), w, ws]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv", "part", "i", "s1", "s2", "u1", "u2", "t", "w", "ws"])

    return sorted_.select("conv", "turn", "role", "text").mapInArrow(run, "conv long, part long, i long, s1 long, s2 long, u1 long, u2 long, t long, w long, ws long")


def _numbered(local: DataFrame, d: Digester, paths: list) -> DataFrame:
    """``local`` without part, as if each conversation had been one part."""
    ends = local.groupBy("conv", "part").agg(F.max("i").alias("n"), F.max("ws").alias("words"))
    several = ends.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")
    last = ends.join(several, "conv").join(local.select("conv", "part", F.col("i").alias("n"), "s1", "s2"), ["conv", "part", "n"])

    def carry(table: pa.Table) -> pa.Table:
        out = []
        i = words = s1 = s2 = 0
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            f1, f2 = pow(d.bases[0], i, P), pow(d.bases[1], i, P)
            out.append((r["conv"], r["part"], i, s1, s2, words, f1, f2))
            s1, s2 = (s1 + r["s1"] * f1) % P, (s2 + r["s2"] * f2) % P
            i, words = i + r["n"], words + r["words"]
        return pa.table({c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate(("conv", "part", "i0", "c1", "c2", "w0", "f1", "f2"))})

    # at most two rows a task of _local(): the conversations that span parts
    carried = stored(last.groupBy("conv").applyInArrow(carry, "conv long, part long, i0 long, c1 long, c2 long, w0 long, f1 long, f2 long"), paths)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names if n not in ("i0", "c1", "c2", "w0", "f1", "f2")}
            add = {n: b.column(n).fill_null(1 if n in ("f1", "f2") else 0).to_numpy() for n in ("i0", "c1", "c2", "w0", "f1", "f2")}
            u = [mulmod(col[f"u{k}"], add[f"f{k}"]) for k in (1, 2)]
            s = [addmod(mulmod(col[f"s{k}"], add[f"f{k}"]), add[f"c{k}"]) for k in (1, 2)]
            columns = [col["conv"], col["i"] + add["i0"], *s, *u, col["t"], col["w"], col["ws"] + add["w0"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv", "i", "s1", "s2", "u1", "u2", "t", "w", "ws"])

    return local.join(F.broadcast(carried), ["conv", "part"], "left").mapInArrow(shift, "conv long, i long, s1 long, s2 long, u1 long, u2 long, t long, w long, ws long")


def _rebuilt(turns: DataFrame, d: Digester, base: Column, head: Column, paths: list) -> tuple[DataFrame, DataFrame]:
    """Steps (conv, d, a, b, pa, pb, t, w, ws, last) of the rebuilt conversations, and (conv, n) of these."""
    first = F.collect_list(F.when(F.col("i") <= MOST_HEAD, F.struct("i", "s1", "s2", "u1", "u2", "t", "w", "ws")))
    own = turns.groupBy("conv").agg(F.max("i").alias("n_own"), F.array_sort(first).alias("first"))
    own = stored(own.withColumns({"base": base, "h": head.cast("int")}), paths)
    given = own.select(F.col("conv").alias("base"), F.col("first").alias("given"))
    both = own.join(given, "base", "left").withColumn("given", F.coalesce("given", F.array().cast(given.schema["given"].dataType)))
    k = F.least(F.col("h"), F.size("given"))
    at = lambda xs, n, c: F.when(n > 0, F.element_at(xs, n)[c]).otherwise(F.lit(0).cast("long"))
    j = F.least(F.col("h").cast("long"), F.col("n_own")).cast("int")
    figures = {"k": k, "j": j, "n": k + F.col("n_own") - j}
    figures |= {f"g{c}": at("given", k, f"s{c}") for c in "12"} | {f"o{c}": at("first", j, f"s{c}") for c in "12"}
    figures |= {"gw": at("given", k, "ws"), "ow": at("first", j, "ws")}
    convs = stored(both.withColumns(figures), paths)
    part = F.floor(F.col("i") / BUCKET).cast("int")
    split = convs.where("n > k").select("conv", "k", "j", "n", "g1", "g2", "o1", "o2", "gw", "ow", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_own") / BUCKET).cast("int"))).alias("part"))
    tails = turns.withColumn("part", part).join(split, ["conv", "part"]).where("i > j")
    names = ["conv", "d", "a", "b", "pa", "pb", "t", "w", "ws", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in b.schema.names}
            move = c["k"].astype(np.int64) - c["j"]
            digest, above = [], []
            for lane, base_ in zip("12", d.bases, strict=True):
                inverse = pow(base_, -1, P)
                factor = np.array([pow(inverse, -m, P) if m < 0 else pow(base_, m, P) for m in range(-MOST_HEAD, MOST_HEAD + 1)], np.int64)[move + MOST_HEAD]
                own_ = mulmod(submod(c[f"s{lane}"], c[f"o{lane}"]), factor)
                digest.append(addmod(own_, c[f"g{lane}"]))
                above.append(submod(digest[-1], mulmod(c[f"u{lane}"], factor)))
            columns = [c["conv"], c["i"] + move, *digest, *above, c["t"], c["w"], c["ws"] - c["ow"] + c["gw"], c["n"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    tail = tails.select("conv", "i", "s1", "s2", "u1", "u2", "t", "w", "ws", "k", "j", "n", "g1", "g2", "o1", "o2", "gw", "ow").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    heads = convs.select("conv", "n", F.explode(F.slice("given", 1, F.col("k"))).alias("x"))
    less = lambda s, u: F.pmod(F.col(s) - F.col(u), F.lit(P))
    heads = heads.select("conv", F.col("x.i").alias("d"), F.col("x.s1").alias("a"), F.col("x.s2").alias("b"), less("x.s1", "x.u1").alias("pa"), less("x.s2", "x.u2").alias("pb"), "x.t", "x.w", "x.ws", "n")
    steps = heads.union(tail).select("conv", "d", "a", "b", "pa", "pb", "t", "w", "ws", (F.col("d") == F.col("n")).alias("last"))
    return steps, convs.select("conv", "n")


def _same(least: Column, most: Column) -> Column:
    return F.when(least == most, least).otherwise(F.raise_error(F.lit("two prefixes share a digest; run again")))


def _nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, a, b, pa, pb, w, ws, m, n, ends) of the distinct prefixes, the root included."""
    checked = {c: F.struct(F.min(c).alias("x"), F.max(c).alias("y")).alias(c) for c in ("pa", "pb", "t", "w", "ws")}
    counted = steps.groupBy("d", "a", "b").agg(F.min("conv").alias("m"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ends"), *checked.values())
    counted = counted.where(_same(F.col("t.x"), F.col("t.y")).isNotNull())
    nodes = counted.select("d", "a", "b", *[_same(F.col(f"{c}.x"), F.col(f"{c}.y")).alias(c) for c in ("pa", "pb", "w", "ws")], "m", "n", "ends")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("m"), F.count("*").alias("n"), F.coalesce(F.sum((F.col("n") == 0).cast("long")), zero).alias("ends")).where("n > 0")
    return nodes.union(root.select(*[zero.alias(c) for c in ("d", "a", "b")], zero.alias("pa"), zero.alias("pb"), zero.alias("w"), zero.alias("ws"), "m", "n", "ends"))


def _sharded(chains: DataFrame, steps: DataFrame, nodes: DataFrame, limit: int, paths: list) -> DataFrame:
    """``chains`` with shard: -1 for those with more than ``limit`` members and the root's."""
    # at most turns / limit rows, as each has more than limit turns of its own
    heavy = stored(nodes.where((F.col("n") > limit) | (F.col("d") == 0)).select("d", "a", "b"), paths)
    below = steps.join(F.broadcast(heavy.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"))), ["d", "pa", "pb"])
    top = below.join(F.broadcast(heavy), ["d", "a", "b"], "left_anti").select(F.col("conv").alias("m"), F.xxhash64("a", "b").alias("top"))
    shards = max(1, -(-chains.count() // SHARD_CHAINS))
    heavy_chain = (F.col("n") > limit) | (F.col("lo") == 0)
    light = chains.where(~heavy_chain).join(top, "m").withColumn("shard", F.pmod("top", F.lit(shards)).cast("int")).drop("top")
    return stored(light.union(chains.where(heavy_chain).withColumn("shard", F.lit(-1)).select(*light.columns)), paths)


def accumulate(keys: np.ndarray, parents: np.ndarray, n: np.ndarray, words: np.ndarray, owner: np.ndarray, more: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Of each chain of a shard: children of its last node, leaves, tokens saved in the chain
    and below it (in the chain itself: in ``own``), and the parent's owner (-1: not in the shard).

    keys, parents: depth and digest of the chains' last nodes and of the nodes above them;
    more: children, leaves and saved tokens of subtrees in other shards, by chain.
    """
    table = SlotTable(keys)
    slot, up = table.slots(keys), table.slots(parents)
    size = len(keys)
    members, tokens, depth, ids, above = (np.zeros(size, np.int64) for _ in range(5))
    members[slot], tokens[slot], depth[slot], ids[slot], above[slot] = n, words, keys[:, 0], owner, up
    children, leaves, below = (np.zeros(size, np.int64) for _ in range(3))
    if more is not None:
        children[slot], leaves[slot], below[slot] = more["children"], more["leaves"], more["saved"]
    has = above >= 0
    np.add.at(children, above[has], 1)
    leaves[children == 0] = 1
    own = (members - 1) * tokens
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[has[level]]
        np.add.at(leaves, above[level], leaves[level])
        np.add.at(below, above[level], below[level] + own[level])
    return {"children": children[slot], "leaves": leaves[slot], "below": below[slot], "own": own[slot], "inside": has[slot], "above": np.where(has[slot], ids[above[slot]], -1)}


_CHAIN = ["m", "n", "lo", "hi", "a", "b", "pa", "pb", "words", "w_hi", "shard"]
_RESULT = "m long, n long, lo long, hi long, pa long, pb long, w_hi long, children long, leaves long, below long, own long, inside boolean, above long"


def _counted(table: pa.Table, more: dict[str, np.ndarray] | None = None) -> pa.Table:
    col = {c: table.column(c).to_numpy() for c in table.column_names}
    keys = np.stack([col["hi"], col["a"], col["b"]], axis=1)
    parents = np.stack([col["lo"] - 1, col["pa"], col["pb"]], axis=1)
    out = accumulate(keys, parents, col["n"], col["words"], col["m"], more)
    return pa.table({c: col[c] for c in ("m", "n", "lo", "hi", "pa", "pb", "w_hi")} | out)


def _chain_figures(chains: DataFrame, paths: list) -> DataFrame:
    """(m, n, lo, hi, w_hi, children, leaves, below, parent) of the chains."""
    def one(table: pa.Table) -> pa.Table:
        return _counted(table)

    light = stored(chains.where("shard >= 0").groupBy("shard").applyInArrow(one, _RESULT), paths)
    tops = light.where("not inside").groupBy((F.col("lo") - 1).alias("hi"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    tops = tops.agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.col("below") + F.col("own")).alias("saved"))
    fed = chains.where("shard < 0").join(tops, ["hi", "a", "b"], "left").select(*_CHAIN, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("children", "leaves", "saved")])

    def heavy(table: pa.Table) -> pa.Table:
        return _counted(table.select(_CHAIN), {c: table.column(c).to_numpy() for c in ("children", "leaves", "saved")})

    top = stored(fed.groupBy("shard").applyInArrow(heavy, _RESULT), paths)
    # the owners of the heavy nodes, for the chains right below them
    owners = chains.where("shard < 0").select((F.col("hi") + 1).alias("lo"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("m").alias("owner"))
    low = light.where("not inside").join(F.broadcast(owners), ["lo", "pa", "pb"]).withColumn("above", F.col("owner")).select(*light.columns)
    every = light.where("inside").union(low).union(top)
    return every.select("m", "n", "lo", "hi", "w_hi", "children", "leaves", "below", F.when(F.col("lo") > 0, F.col("above")).alias("parent"))


def _end_hashes(steps: DataFrame, convs: DataFrame, tasks: int) -> DataFrame:
    """(d, a, b, ends_sha256): the ids of the conversations that end at a node, by ranges and in order."""
    zero = F.lit(0).cast("long")
    ends = steps.where("last").select("d", "a", "b", "conv").union(convs.where("n = 0").select(zero, zero, zero, "conv"))
    key = ["d", "a", "b", "conv"]
    names = ["d", "a", "b", "first", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(k).to_numpy() for k in range(4)]
            cut = np.flatnonzero(np.concatenate(([True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1]))))
            ids = [",".join(map(str, x.tolist())) for x in np.split(c[3], cut[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cut]) for x in c), pa.array(ids)], names=names)

    packed = ends.repartitionByRange(tasks, *key).sortWithinPartitions(*key).mapInArrow(pack, "d long, a long, b long, first long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, sha256()
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in ("d", "a", "b", "ids")), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = k, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _hash_rows(out)
        if now is not None:
            yield _hash_rows([(*now, state.hexdigest())])

    return packed.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "first").mapInArrow(hashed, "d long, a long, b long, ends_sha256 string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["d", "a", "b", "ends_sha256"])


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    base: Column | None = None,
    head: Column | None = None,
    limit: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per distinct prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``base`` and ``head``, over the column ``conv``, name the conversation whose first turns replace as
    many of a conversation's own, and their number, 3 at most; by default none.
    """
    paths: list = []
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = bounded_batches(conversations).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).where("conv is not null")
    size = turns.select("conv").count()
    tasks = tasks or max(8, -(-size // TASK_TURNS))
    limit = limit or max(LEAST_LIMIT, int(size**0.5))
    d = Digester.new()
    numbered = stored(_numbered(stored(_local(turns, tasks, d), paths), d, paths), paths)
    steps, convs = _rebuilt(numbered, d, F.col("conv") if base is None else base, F.lit(0) if head is None else F.least(head, F.lit(MOST_HEAD)), paths)
    steps = stored(steps, paths)
    nodes = stored(_nodes(steps, convs), paths)
    ends = [F.min("d").alias("lo"), F.max("d").alias("hi"), F.max_by("a", "d").alias("a"), F.max_by("b", "d").alias("b"), F.min_by("pa", "d").alias("pa"), F.min_by("pb", "d").alias("pb")]
    chains = stored(nodes.groupBy("m", "n").agg(*ends, F.sum("w").alias("words"), F.max("ws").alias("w_hi")), paths)
    figures = stored(_chain_figures(_sharded(chains, steps, nodes, limit, paths), paths), paths)
    # a long chain meets its nodes by buckets of depths
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    wide = figures.withColumn("part", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    hashes = stored(_end_hashes(steps, convs, tasks), paths)
    all_ = nodes.withColumn("part", bucket("d")).join(wide, ["m", "n", "part"]).join(hashes, ["d", "a", "b"], "left")
    bottom = F.col("d") == F.col("hi")
    out = all_.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("lo"), F.col("m")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("w_hi") - F.col("ws") + F.col("w"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    out = stored(out)
    drop(conversations.sparkSession, paths)
    return out
