"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

1. Rows of equal label and vector form a class at once; its smallest id stands for it and
   carries their number.
2. Spherical k-means on a bounded sample (``PER_CELL`` vectors for each cell, ``LEAST_SAMPLE``
   at least) gives a quarter as many centres as the square root of the number of classes, at every
   size. A vector's home is the cell of its nearest centre.
3. A pair may lie on both sides of a border. So a vector also visits each cell whose
   border with its home is nearer than ``margin()``: of two linked vectors, one in that cell,
   the other is at most sin(angle) away from the border, and in d dimensions rarely
   more than ``SIGMAS / sqrt(d)`` of that. In few dimensions that is the whole of it, and no pair is lost.
4. Cells are put in an order in which near ones follow each other, and of a label's cells stretches that hold about
   ``BUNDLE`` bytes of vectors are bundled. A vector is sent once to each bundle that it visits, with the list of its cells
   there, so what is written grows with the bundles of a label and not with the cells. In a bundle the home vectors of
   each cell are multiplied with all vectors of the cell, those near the threshold in double precision. Bundles of more than ``BLOCK`` bytes
   go in pairs of blocks. A task returns the number of each vector's links and one row for each vector that has any, which
   names the smallest vector it reaches there. So the links of a hot cell are counted in full, and no pair becomes a row.
5. Those rows close to components; the smallest id of each is kept.

Vectors that are null, zero, or hold null or non-finite components, and rows of a null label
have no links; so have rows with a null id, which are returned as they come. Only vectors of
equal length are compared; lengths other than the usual one share one cell. Rows
that repeat an id are one vector, of which the row of the least label and bytes counts.
An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, drop, stored
from .components import components

#: Least cosine of a link.
LEAST = 0.93
#: Sampled vectors for each cell; least sample; rounds of k-means.
PER_CELL, LEAST_SAMPLE, ROUNDS = 8, 6_000, 8
SIGMAS = 3.5
#: Bytes, as doubles, of the home vectors of a bundle; of all vectors of a block; salts of a label.
BUNDLE, BLOCK, SALTS = 16 << 20, 64 << 20, 32
#: Least vectors of either; products that are looked at at once; share of them beyond which all are made in double precision.
LEAST_ROWS, AT_ONCE, DENSE = 2_048, 1 << 22, 0.01


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that the norm neither overflows nor vanishes
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(dim: int, least: float = LEAST) -> float:
    """How near the border of a cell a vector counts as its visitor."""
    sine = (1 - least * least) ** 0.5
    return sine * min(1.0, SIGMAS / dim**0.5)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres of the rows of ``x``, which are unit vectors; cells without rows are left out."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centre = total[size > 1e-9] / size[size > 1e-9, None]
    return centre


def cells_of(x: np.ndarray, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each row's home and of the cells that it visits."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 1e-12))
    inside = (near[np.arange(len(x)), home][:, None] - near) / apart <= width
    inside[np.arange(len(x)), home] = True
    row, cell = np.nonzero(inside)
    return row, cell, home[row] == cell


def tour(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which near ones follow each other: halves across their widest direction, again and again."""
    todo, out = [np.arange(len(centres))], []
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            out += own.tolist()
            continue
        x = centres[own] - centres[own].mean(axis=0)
        far = x[(x * x).sum(axis=1).argmax()]
        own = own[np.argsort(x @ far, kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.array(out, np.int64)


def _prepared(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, type]:
    """(id, label, dim, digest, vec) and the type of the numbers: vectors as bytes; dim 0 for those without links."""
    single = embeddings.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = bounded_batches(embeddings).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            dim, digest, vec = [], [], []
            for i, null in enumerate(lists.is_null().to_pylist()):
                v = values[offsets[i] : offsets[i + 1]]
                good = not null and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                data = v.astype(kind).tobytes() if good else None
                dim.append(len(v) if good else 0)
                vec.append(data)
                digest.append(blake2b(data, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], names=["id", "label", "dim", "digest", "vec"])

    return rows.mapInArrow(run, "id long, label string, dim int, digest binary, vec binary"), kind


def _vectors(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def _placed(reps: DataFrame, dim: int, centres: np.ndarray, width: float, kind: type, vectors: bool = True) -> DataFrame:
    """(label, dim, bundle, home, cells, id, n, vec): a row for each bundle that a class lies in or visits.

    ``home`` is the class's own cell if the bundle has it, else -2; vectors of another length have cell and bundle -1.
    Without ``vectors`` vec is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usual, bundles = b.column(1).to_numpy() == dim, b.column(5).to_numpy().astype(np.int64)
            other, own = np.flatnonzero(~usual), np.flatnonzero(usual)
            parts = [(other, np.full(len(other), -1), np.ones(len(other), bool))]
            if len(own):
                x = unit(_vectors(b.column(4).take(pa.array(own)), kind))
                for i in range(0, len(own), 256):
                    r, c, h = cells_of(x[i : i + 256], centres, width)
                    parts.append((own[i + r], c, h))
            for row, cell, home in parts:
                if not len(row):
                    continue
                bundle = np.where(cell < 0, -1, cell * bundles[row] // len(centres))
                # a row's cells ascend, so those of a bundle stand together
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])))
                at = np.maximum.reduceat(np.where(home, cell, -2), first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                part = b.take(pa.array(row[first]))
                vec = part.column(4) if vectors else pa.nulls(len(first), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bundle[first], pa.int32()), pa.array(at, pa.int32()), lists, part.column(2), part.column(3), vec], names=["label", "dim", "bundle", "home", "cells", "id", "n", "vec"])

    return reps.select("label", "dim", "id", "n", "vec", "bundles").mapInArrow(run, "label string, dim int, bundle int, home int, cells array<int>, id long, n long, vec binary")


def _in_blocks(placed: DataFrame, light: DataFrame, block: int) -> DataFrame:
    """``placed`` with qb, ab (a pair of blocks of the bundle), asks and answers; ``light`` are the same rows without vectors.

    Only bundles of more than a block are broadcast, so they are few.
    """
    key = ["label", "dim", "bundle"]
    large = light.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = large.select(*key, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = placed.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda q, a, asks, answers: F.struct(q.alias("qb"), a.alias("ab"), asks.alias("asks"), answers.alias("answers"))
    yes, no, home = F.lit(True), F.lit(False), F.col("home") >= -1
    # a row meets its own block once, as both
    answering = F.transform(every, lambda q: pair(q, own, home & (q == own), yes))
    asking = F.when(home, F.transform(F.filter(every, lambda a: a != own), lambda a: pair(own, a, yes, no)))
    goes = F.concat(answering, F.coalesce(asking, F.slice(answering, 1, 0)))
    return rows.select(*key, "home", "cells", "id", "n", "vec", F.explode(goes).alias("p")).select(*key, "home", "cells", "id", "n", "vec", "p.*")


def near_pairs(q: np.ndarray, a: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of q, row of a) of unit vectors with cosine of ``least`` at least, a stretch of q at a time.

    Single precision shows which pairs may be; those are decided in double precision.
    """
    # the rounding of d products and sums, twice over
    spare = (q.shape[1] + 8) * 2.0**-23
    single, step = a.astype(np.float32).T, max(1, AT_ONCE // max(1, len(a)))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        row, col = np.nonzero(part.astype(np.float32) @ single >= np.float32(least - spare))
        if len(row) > DENSE * len(part) * len(a):
            row, col = np.nonzero(part @ a.T >= least)
        else:
            keep = [np.einsum("ij,ij->i", part[row[k : k + 65_536]], a[col[k : k + 65_536]]) >= least for k in range(0, len(row), 65_536)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            row, col = row[keep], col[keep]
        yield i + row, col


def join_nodes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least node of each node's component) after the edges a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def linked_in_bundle(ids: np.ndarray, n: np.ndarray, x: np.ndarray, home: np.ndarray, row: np.ndarray, cell: np.ndarray, asks: np.ndarray, answers: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, number of links, smallest id reached) of the rows with links; links are counted for the asking rows.

    ``row`` and ``cell`` tell which cells each row lies in or visits; a row asks in its home.
    """
    # rows of one id are one node
    distinct, node = np.unique(ids, return_inverse=True)
    label, total, touched = np.arange(len(distinct)), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
    there = answers[row]
    row, cell = row[there], cell[there]
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    asking = np.flatnonzero(asks)
    asking = asking[np.argsort(home[asking], kind="stable")]
    for c in np.unique(home[asking]).tolist():
        q = asking[np.searchsorted(home[asking], c) : np.searchsorted(home[asking], c, "right")]
        a = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
        for i, j in near_pairs(x[q], x[a], least):
            one, two = node[q[i]], node[a[j]]
            apart = one != two
            one, two, weight = one[apart], two[apart], n[a[j[apart]]]
            np.add.at(total, one, weight)
            touched[one] = touched[two] = True
            label = join_nodes(label, one, two)
    out = np.flatnonzero(touched)
    return distinct[out], total[out], distinct[label[out]]


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, cells: int | None = None, block: int | None = None, bundle: int | None = None) -> DataFrame:
    """Per id: id_col, n_links (other vectors linked directly), component_id (least id reachable), kept (is that id).

    ``cells``, ``block`` and ``bundle``: numbers of cells, and of vectors of a block and a bundle, in place of the rules above.
    """
    spark = embeddings.sparkSession
    paths: list = []
    whole: list = []
    prepared, kind = _prepared(embeddings, id_col, vector_col, label_col)
    rows = stored(prepared, whole)
    ids = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("digest").isNull().alias("bad"), F.col("label").isNull().alias("none"), "label", "digest", "dim")).alias("x"))
    ids = stored(ids.select("id", "x.label", "x.digest", "x.dim"), paths)
    classes = ids.where("label is not null and digest is not null").groupBy("label", "digest", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    nodes = ids.join(classes.drop("dim"), ["label", "digest"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
    dims = {r[0]: r[1] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()}
    dim, size = next(iter(dims.items()), (1, 0))
    bundle = bundle or max(LEAST_ROWS, BUNDLE // (8 * dim))
    block = block or max(LEAST_ROWS, BLOCK // (8 * dim))
    # a label's only class has nothing to meet; classes meet the figures of a large label by a salt
    labels = classes.groupBy("label").agg(F.count("*").alias("size")).where("size > 1").select("label", F.ceil(F.col("size") / bundle).cast("int").alias("bundles"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = classes.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(SALTS)).cast("int")).join(labels, ["label", "salt"])
    asked = asked.select(F.col("label").alias("__label"), F.col("digest").alias("__digest"), F.col("rep").alias("id"), "n", "bundles")
    held = rows.join(asked, "id").where("label = __label and digest = __digest").dropDuplicates(["id"])
    reps = stored(held.select("label", "dim", "id", "n", "vec", "bundles"), paths)
    loose = rows.where("id is null").count()
    drop(spark, whole)
    cells = cells or max(1, round(size**0.5 / 4))
    want = max(LEAST_SAMPLE, PER_CELL * cells)
    sample = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toArrow().column(0)
    centres = spherical_kmeans(unit(_vectors(sample, kind)), cells) if len(sample) else np.zeros((1, dim))
    centres = centres[tour(centres)]
    placed, light = (_placed(reps, dim, centres, margin(dim, least), kind, v) for v in (True, False))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, answers = (table.column(c).to_numpy() for c in ("asks", "answers"))
        got = (np.zeros(0, np.int64),) * 3
        if asks.any() and answers.any():
            lists = table.column("cells")
            row, cell = np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists).to_numpy()
            got = linked_in_bundle(table.column("id").to_numpy(), table.column("n").to_numpy(), unit(_vectors(table.column("vec"), kind)), table.column("home").to_numpy(), row, cell, asks, answers, least)
        return pa.table(dict(zip(("id", "links", "reach"), (pa.array(x, pa.int64()) for x in got), strict=True)))

    found = stored(_in_blocks(placed, light, block).groupBy("label", "dim", "bundle", "qb", "ab").applyInArrow(compare, "id long, links long, reach long"), paths)
    reached = components(found.select(F.col("id").alias("a"), F.col("reach").alias("b")), keep=paths)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = links.join(reached.select(F.col("node").alias("id"), "component"), "id", "full").withColumnRenamed("id", "rep")
    out = nodes.join(of_class, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    none = F.lit(None).cast("long")
    unnamed = spark.range(loose).select(none.alias("id"), F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(True).alias("kept"))
    out = stored(out.union(unnamed).withColumnRenamed("id", id_col))
    drop(spark, paths)
    return out


def drop_near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """``embeddings`` with one vector, of the smallest id, of each group of near-duplicates; all columns stay."""
    gone = near_vectors(embeddings, id_col, vector_col, label_col, least).where("not kept").select(id_col)
    return embeddings.join(gone, id_col, "left_anti").select(*embeddings.columns)
