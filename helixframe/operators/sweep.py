"""What ranges tell of the features that overlap them, bin by bin: no pair is made.

Ranges and features meet in bins of ``SWEPT`` places, each once. A bin's group holds what lies in so many places; numbers of overlaps
come from its features' sorted ends, the best feature from one pass over them, the best written last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Length of the bins.
SWEPT = 16_384


def _binned(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with __first and __last, and of ``right`` with __r0 and __r1, one for each ``__bin`` that they lie in."""
    bins = lambda a, b: F.explode_outer(F.when(F.col(a) <= F.col(b), F.sequence(F.floor(F.col(a) / SWEPT), F.floor(F.col(b) / SWEPT))))
    a = left.withColumns({"__first": left_range[0].cast("long"), "__last": left_range[1].cast("long")}).withColumn("__bin", bins("__first", "__last"))
    b = right.withColumns({"__r0": right_range[0].cast("long"), "__r1": right_range[1].cast("long")}).where("__r0 <= __r1").withColumn("__bin", bins("__r0", "__r1"))
    return a.withColumn("__k", F.col(on[0])), b.withColumn("__k", F.col(on[1])).drop(on[1]).where("__k is not null")


def _met(left: DataFrame, right: DataFrame, each, more: str) -> DataFrame:
    schema = StructType([x for x in left.schema if x.name not in ("__k", "__bin")] + list(StructType.fromDDL(more)))
    return left.groupBy("__k", "__bin").cogroup(right.groupBy("__k", "__bin")).applyInArrow(each, schema)


def _several() -> Column:
    """Whether a range lies in several bins."""
    return F.coalesce(F.floor(F.col("__first") / SWEPT) < F.floor(F.col("__last") / SWEPT), F.lit(False))


def overlaps_of(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], key: list[str], kind: str, kinds: dict[str, str]) -> DataFrame:
    """``left`` with a column for each of ``kinds`` (column: value of ``kind`` in ``right``): how many such rows of ``right`` overlap.

    ``key`` is unique in ``left``. Null bounds and ranges out of order overlap nothing.
    """
    a, b = _binned(left, right.select(on[1], kind, right_range[0].alias("__b0"), right_range[1].alias("__b1")), on, left_range, (F.col("__b0"), F.col("__b1")))

    def each(key_: tuple, v: pa.Table, f: pa.Table) -> pa.Table:
        out = v.drop_columns(["__k", "__bin"])
        placed = v.num_rows > 0 and key_[1].as_py() is not None
        if placed:
            edge = int(key_[1].as_py()) * SWEPT
            first, last = v["__first"].to_numpy(), v["__last"].to_numpy()
        for name, value in kinds.items():
            n = np.zeros(v.num_rows, np.int64)
            if placed:
                own = f.filter(pc.equal(f[kind], value))
                begins, ends = np.sort(own["__r0"].to_numpy()), np.sort(own["__r1"].to_numpy())
                # a range that comes from the bin before has met what lies on this bin's edge there
                before = np.where(first >= edge, np.searchsorted(ends, first, "left"), np.searchsorted(begins, edge, "left"))
                n = np.searchsorted(begins, last, "right") - before
            out = out.append_column(name, pa.array(n, pa.int64()))
        return out

    rows = _met(a, b, each, ", ".join(f"{name} long" for name in kinds))
    whole = rows.where(_several()).groupBy(*key).agg(*[F.first(c).alias(c) for c in left.columns if c not in key], *[F.sum(n).alias(n) for n in kinds])
    return rows.where(~_several()).select(*left.columns, *kinds).unionByName(whole.select(*left.columns, *kinds))


def best_of(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], key: list[str], order: list[str]) -> DataFrame:
    """``left`` with the columns ``order`` of the row of ``right`` that overlaps and comes first by them; nulls where none does.

    ``key`` is unique in ``left``. The columns ``order`` are numbers or strings without nulls.
    """
    of = right.select(on[1], *order, right_range[0].alias("__b0"), right_range[1].alias("__b1"))
    a, b = _binned(left, of, on, left_range, (F.col("__b0"), F.col("__b1")))
    kept = StructType([x for x in of.schema if x.name in order])

    def each(key_: tuple, v: pa.Table, f: pa.Table) -> pa.Table:
        out, best = v.drop_columns(["__k", "__bin"]), np.full(v.num_rows, f.num_rows, np.int64)
        f = f.take(pc.sort_indices(f, [(c, "ascending") for c in order]))
        if v.num_rows and f.num_rows:
            edge = int(key_[1].as_py()) * SWEPT
            clip = lambda x: np.clip(x.to_numpy() - edge, 0, SWEPT - 1)
            least = np.full(SWEPT, f.num_rows, np.int64)
            for k, x, y in zip(range(f.num_rows - 1, -1, -1), clip(f["__r0"])[::-1].tolist(), clip(f["__r1"])[::-1].tolist(), strict=True):
                least[x : y + 1] = k
            first, last = clip(v["__first"]), clip(v["__last"])
            size, wide = np.frexp((last - first + 1).astype(float))[1] - 1, 0  # of 2 ** size places or more
            while True:
                own = size == wide
                best[own] = np.minimum(least[first[own]], least[last[own] - (1 << wide) + 1])
                if wide >= size.max():
                    break
                half = 1 << wide
                least[:-half] = np.minimum(least[:-half], least[half:])
                wide += 1
        index = pa.array(best, mask=best == f.num_rows)
        for c in order:
            out = out.append_column(c, f[c].take(index))
        return out

    rows = _met(a, b, each, kept.simpleString()[len("struct<") : -1])
    first = F.min(F.when(F.col(order[0]).isNotNull(), F.struct(*order))).alias("__best")
    whole = rows.where(_several()).groupBy(*key).agg(*[F.first(c).alias(c) for c in left.columns if c not in key], first)
    whole = whole.select(*left.columns, *[F.col(f"__best.{c}").alias(c) for c in order])
    return rows.where(~_several()).select(*left.columns, *order).unionByName(whole)
