"""The nearest interval of another table, by bins and two levels of carried neighbours.

A position's nearest interval on one side either ends (begins) in the position's own bin, which is an
equi-join on it, or is the outermost of the nearest bin on that side that holds any. For the latter,
the bins of a group of ``GROUP`` lie in one array that all positions of the group join, and
only what the groups before leave is carried from group to group: a window over a
chromosome's groups (its length / (BIN x GROUP) rows), never over its positions or intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN, GROUP = 4_096, 256


def _carried(right: DataFrame, spans: DataFrame, before: bool) -> DataFrame:
    """(n_chrom, n_group, bins, carry): the bins of a group with their outermost interval, and that of the groups beyond.

    ``before``: intervals that end before a position; else those that begin behind it.
    """
    edge = F.col("n_end") if before else F.col("n_start")
    least = F.struct((-edge if before else edge).alias("k"), F.col("n_id").alias("id"))
    binned = right.groupBy("n_chrom", F.floor(edge / BIN).alias("bin")).agg(F.min(least).alias("best"))
    groups = binned.groupBy("n_chrom", F.floor(F.col("bin") / GROUP).alias("n_group")).agg(F.collect_list(F.struct("bin", "best")).alias("bins"), F.min("best").alias("best"))
    every = spans.select("n_chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("n_group")).join(groups, ["n_chrom", "n_group"], "left")
    order = Window.partitionBy("n_chrom").orderBy(F.col("n_group") if before else F.desc("n_group")).rowsBetween(Window.unboundedPreceding, -1)
    return every.select("n_chrom", "n_group", "bins", F.min("best").over(order).alias("carry"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], right_id: str) -> DataFrame:
    """``left`` with nearest_id, nearest_distance and nearest_side (left, right; inside where they overlap).

    Distances are between the nearest bases of closed ranges; of equally near ones the smallest id counts.
    ``key`` is unique in ``left``. All three are null where the chromosome has no interval.
    """
    l = left.select(*key, F.col(on[0]).alias("l_chrom"), left_range[0].cast("long").alias("l0"), left_range[1].cast("long").alias("l1"))  # noqa: E741
    r = right.select(F.col(on[1]).alias("n_chrom"), right_range[0].cast("long").alias("n_start"), right_range[1].cast("long").alias("n_end"), F.col(right_id).alias("n_id"))
    r = r.where("n_start <= n_end")
    width = BIN * GROUP
    spans = r.select("n_chrom", F.col("n_end").alias("x")).union(l.select("l_chrom", "l1")).groupBy("n_chrom").agg(F.floor(F.max("x") / width).alias("last"))
    found = None
    for before in (True, False):
        at = F.col("l0") if before else F.col("l1")
        side = F.lit("left" if before else "right")
        rows = l.withColumns({"bin": F.floor(at / BIN), "n_group": F.floor(at / width), "n_chrom": F.col("l_chrom")})
        edge = F.col("n_end") if before else F.col("n_start")
        away = (at - edge) if before else (edge - at)
        same = rows.drop("n_group").join(r.withColumn("bin", F.floor(edge / BIN)), ["n_chrom", "bin"]).where(away > 0)
        near = same.select(*key, away.alias("d"), F.col("n_id").alias("id"), side.alias("side"))
        beyond = F.filter("bins", lambda b: (b["bin"] < F.col("bin")) if before else (b["bin"] > F.col("bin")))
        best = F.array_min(F.array_compact(F.concat(F.coalesce(F.transform(beyond, lambda b: b["best"]), F.array().cast("array<struct<k:bigint,id:string>>")), F.array("carry"))))
        far = rows.join(_carried(r, spans, before), ["n_chrom", "n_group"]).withColumn("best", best).where("best is not null")
        far = far.select(*key, (at + F.col("best.k") if before else F.col("best.k") - at).alias("d"), F.col("best.id").alias("id"), side.alias("side"))
        both = near.union(far)
        found = both if found is None else found.union(both)
    from .intervals import interval_join

    over = interval_join(l, r, ("l_chrom", "n_chrom"), (F.col("l0"), F.col("l1")), (F.col("n_start"), F.col("n_end")))
    found = found.union(over.select(*key, F.lit(0).cast("long").alias("d"), F.col("n_id").alias("id"), F.lit("inside").alias("side")))
    one = found.groupBy(*key).agg(F.min(F.struct("d", "id", "side")).alias("x")).select(*key, F.col("x.id").alias("nearest_id"), F.col("x.d").alias("nearest_distance"), F.col("x.side").alias("nearest_side"))
    return left.join(one, key, "left")
