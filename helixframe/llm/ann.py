"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors at most, by a hash of the id) the graph of nearest
neighbours is cut into balanced parts, and a small classifier learns to name the part of
a vector. There are half as many parts as the square root of the number of vectors, from 2
to ``MOST_PARTS``. Every row is then stored in the part it is told, and a query visits its
most probable parts until their probabilities reach a mass; the candidates there are ranked
by their exact inner product. The mass is the one that gave ``TARGET`` recall on rows of the
sample that were held back from the partition and the classifier.

Parts are held in blocks of ``BLOCK`` rows and the queries of a part in blocks of as many,
so neither a hot part nor a repeated vector ends in one task; a vector is copied once for
each block of queries that visit its own part. Vectors that are null, zero, hold null or
non-finite components, or differ in length from the sample's usual length take no part; so
do rows with a null id. Fewer candidates than k give fewer rows; ties go to the smaller id;
a row that repeats id and vector counts once, and never as their own query's neighbour.
An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, dealt, drop
from ._spark import stored as stored_table

#: Most sampled vectors; rows of the sample for each part.
SAMPLE, PER_PART = 24_000, 40
LEAST_SAMPLE, MOST_PARTS = 6_000, 512
TARGET = 0.95
BLOCK = 16_384
#: Lists of hits that one task merges.
MERGED_LISTS = 20_000
HIDDEN = 64
NEAR = 10


@dataclass
class Router:
    """Softmax classifier with one hidden layer; mass: what visited parts must add up to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts that each query visits, most probable first."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        n = 1 + (total < self.mass).sum(axis=1)
        return [o[:k] for o, k in zip(order, np.minimum(n, p.shape[1]), strict=True)]


def visited_share(router: Router, x: np.ndarray) -> float:
    """Mean share of the parts that queries visit."""
    return float(np.mean([len(v) for v in router.visits(x)]) / router.w2.shape[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: size-limited label propagation from seeds."""
    rng = np.random.default_rng(seed)
    n = len(x)
    most = int(np.ceil(1.1 * n / parts))
    unit = _unit(x)
    centre = unit[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = unit @ centre.T
        own = near.argmax(axis=1)
        for p in range(parts):
            if (own == p).any():
                centre[p] = unit[own == p].mean(axis=0)
        centre = _unit(centre)
    label = np.full(n, -1)
    size = np.zeros(parts, int)
    for i in np.argsort(-near.max(axis=1)):
        for p in np.argsort(-near[i]):
            if size[p] < most:
                label[i] = p
                size[p] += 1
                break
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    bounds = np.searchsorted(both[0], np.arange(n + 1))
    for _ in range(6):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[both[1, bounds[i] : bounds[i + 1]]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != label[i])] = -1
            p = int(votes.argmax())
            if votes[p] > votes[label[i]]:
                size[label[i]] -= 1
                size[p] += 1
                label[i] = p
                moved += 1
        if moved < n // 200:
            break
    return label


def fit_router(x: np.ndarray, parts: int, seed: int = 3) -> Router:
    """Partition four fifths of the sample, fit the classifier to parts of rows and their neighbours,
    find the mass on the other fifth."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    if held.sum() < 50:
        held[:] = False
    x, apart = x[~held], x[held] if held.any() else x
    k = min(NEAR, len(x) - 1)
    parts = min(parts, len(x) // 8)
    if parts < 2 or k < 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    unit = _unit(x)
    params = [rng.normal(0, dim**-0.5, (dim, HIDDEN)) * 2, np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, 1201):
        pick = rng.integers(0, len(x), 256)
        # half the weight on a row's own part, half on its neighbours'
        d = np.zeros((len(pick), parts))
        np.add.at(d, (np.arange(len(pick)), label[pick]), -0.5)
        np.add.at(d, (np.repeat(np.arange(len(pick)), k), label[graph[pick]].ravel()), -0.5 / k)
        h = np.maximum(unit[pick] @ params[0] + params[1], 0)
        z = h @ params[2] + params[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (d + p / p.sum(axis=1, keepdims=True)) / len(pick)
        back = (d @ params[2].T) * (h > 0)
        for i, g in enumerate((unit[pick].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
            g = g + 1e-5 * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (1 - t / 1300) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)
    router = Router(*params, 1.0)
    p = router.probabilities(apart)
    told = p.argmax(axis=1)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    rank = np.argsort(order, axis=1)
    # a neighbour is found if the mass of the parts visited before its own is below the router's
    near = neighbour_graph(apart, min(k, len(apart) - 1))
    needed = np.take_along_axis(before, np.take_along_axis(rank, told[near], axis=1), axis=1).ravel()
    router.mass = float(min(1.0, np.quantile(needed, TARGET) + 1e-9))
    return router


def top(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k candidates of largest inner product; equal vectors score equal.

    Candidates of one id and score count once.
    """
    rows, found, scores = [], [], []

    def ranked(query: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = (vectors[near] * query).sum(axis=1)
        order = np.lexsort((ids[near], -exact))
        i, e = ids[near][order], exact[order]
        new = np.ones(len(order), bool)
        new[1:] = (i[1:] != i[:-1]) | (e[1:] != e[:-1])
        return i[new][:k], e[new][:k]

    for i in range(0, len(queries), 256):
        s = queries[i : i + 256] @ vectors.T
        s[own[i : i + 256, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        for j in range(len(s)):
            near = np.flatnonzero((s[j] >= least[j] - 1e-9 * (1 + abs(least[j]))) & (s[j] > -np.inf)) if least[j] > -np.inf else np.flatnonzero(s[j] > -np.inf)
            best, exact = ranked(queries[i + j], near)
            if len(best) < k and len(near) < (every := np.flatnonzero(s[j] > -np.inf)).size:
                best, exact = ranked(queries[i + j], every)  # what counted once left room for more
            rows.append(np.full(len(best), i + j))
            found.append(best)
            scores.append(exact)
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(scores)) if rows else (none, none, np.zeros(0))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows found for each row whose id is divisible by ``every``."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = bounded_batches(vectors).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    # repeats go first: they would fill the sample and the places of nearer rows
    paths: list = []
    rows = stored_table(rows.dropDuplicates(["id", "v"]), paths)
    n = rows.count()
    parts = parts or int(np.clip(round(n**0.5 / 2), 2, MOST_PARTS))
    size = int(np.clip(PER_PART * parts, LEAST_SAMPLE, SAMPLE))
    sample = rows.orderBy(F.xxhash64("id", F.lit("ann")), "id").limit(size).select("v").toArrow().column("v").combine_chunks()
    lengths = sample.value_lengths().to_numpy()
    dim = Counter(lengths.tolist()).most_common(1)[0][0] if len(lengths) else 1
    x = sample.filter(pa.array(lengths == dim)).flatten().to_numpy().reshape(-1, dim)
    router = fit_router(x, parts)
    rows = rows.where(F.size("v") == dim)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            p = router.probabilities(m)
            ids = b.column(0).to_numpy()
            asks = ids % every == 0
            visits = router.visits(m[asks]) if asks.any() else []
            seen: list = [None] * b.num_rows
            for i, o in zip(np.flatnonzero(asks).tolist(), visits, strict=True):
                seen[i] = o.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(seen, pa.list_(pa.int32()))], names=["id", "raw", "part", "visits"])

    # routed once: three plans read it
    routed = stored_table(rows.mapInArrow(route, "id long, raw binary, part int, visits array<int>"))
    drop(vectors.sparkSession, paths)
    held = routed.groupBy("part").agg(F.count("*").alias("c"))
    asked = routed.where("visits is not null").select(F.explode("visits").alias("part")).groupBy("part").agg(F.count("*").alias("q"))
    # one row for each part: MOST_PARTS at most
    sizes = F.broadcast(held.join(asked, "part").select("part", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / BLOCK).cast("int").alias("asking"), "q"))

    def all_of(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    stored = routed.join(sizes, "part").select("part", F.pmod(F.xxhash64("id", "raw", F.lit(1)), F.col("blocks")).cast("int").alias("block"), all_of("asking").alias("qblock"), "id", "raw", F.lit(False).alias("asks"))
    queries = routed.where("visits is not null").select("id", "raw", F.explode("visits").alias("part")).join(sizes, "part")
    queries = queries.select("part", all_of("blocks").alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("asking")).cast("int").alias("qblock"), "id", "raw", F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        m = _vectors(table.column("raw")).reshape(-1, dim)
        if asks.all() or not asks.any():
            r, f, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            q = r
        else:
            r, f, s = top(m[asks], ids[asks], ids[~asks], m[~asks], k)
            q = ids[asks][r]
        # one row for each query (a repeated id asks more than once): its hits
        edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        ends = pa.array(np.append(edge, len(r)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (s, f)]
        return pa.table({"query_id": pa.array(q[edge], pa.int64()), "scores": lists[0], "ids": lists[1]})

    def merge(table: pa.Table) -> pa.Table:
        lists = [table.column(c).combine_chunks() for c in ("scores", "ids")]
        q = np.repeat(table.column("query_id").to_numpy(), lists[0].value_lengths().to_numpy())
        s, f = (x.flatten().to_numpy() for x in lists)
        order = np.lexsort((f, -s, q))
        q, s, f = q[order], s[order], f[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (f[1:] != f[:-1])
        q, s, f = q[new], s[new], f[new]
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) + 1
        best = rank <= k
        return pa.table({"query_id": q[best], "rank": pa.array(rank[best], pa.int32()), "id": f[best], "score": s[best]})

    found = stored.union(queries).groupBy("part", "block", "qblock").applyInArrow(search, "query_id long, scores array<double>, ids array<long>")
    # a query's lists, one for each block that it visits, meet in one of as many tasks as they need
    lists = sizes.agg(F.coalesce(F.sum(F.col("q") * F.col("blocks")), F.lit(0))).first()[0]
    tasks = 1 + int(lists) // MERGED_LISTS
    shard = F.pmod(F.xxhash64("query_id"), F.lit(tasks)).alias("shard")
    merged = dealt(found.select("*", shard), "shard", tasks).groupBy("shard").applyInArrow(merge, "query_id long, rank int, id long, score double")
    return merged.withColumnRenamed("id", id_col)
