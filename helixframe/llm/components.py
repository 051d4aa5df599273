"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges, so no component has to fit in a
task, and the joins merge, so none passes the driver either; the number of steps grows with the logarithm of the longest path. Each step is
checkpointed to the shared folder, which keeps the plan short and survives the loss
of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: list | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    ``keep`` collects the path of the table that the result reads, for drop().

    Self-loops, nulls, repeated and reversed edges are allowed; self-loops and nulls
    add no node. No edges give no rows.
    """
    spark = edges.sparkSession
    old: list = []
    now: list = []
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), now)
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        old, now = now, []
        e = stored(small.where("a > b").distinct(), now)
        before, state = state, _state(e)
        drop(spark, old)
        if state == before:
            break
    if keep is not None:
        keep += now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
