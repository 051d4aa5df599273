"""Interval joins as equi-joins on bins.

A feature goes to the level whose bins are as long as it is (or a given part of it), so it lies in at
most two bins (or one more than those parts) however long it is; a variant goes to its bins of every level in use. Rows meet on
(chromosome, level, bin) and an exact overlap test follows. A pair that meets in several
bins is kept in the first common one, which needs no distinct. The few bins that hold a
chromosome's arm are split by a salt. Bins are at most four times as long as their features,
so of the rows that meet a fixed share overlap. The join sorts and merges: a small table that grows by its bins or
exons is never taken for one to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 256
#: Each level's bins are this many times longer than those of the level below.
STEP = 4
LEVELS = 11


#: From bins of so many places on, where a bin holds many variants and features are few, variants
#: are dealt to so many salts and features copied to each.
WIDE, SALTS = 1 << 20, 32

#: Length of the bins that unions of ranges are cut into; of those that points are counted in, and bins of a group.
PIECE = 4_096
COUNTED, GROUP = 256, 4_096


def _length(level: Column, shortest: int) -> Column:
    return F.element_at(F.array(*[F.lit(shortest * STEP**k) for k in range(LEVELS)]), level + 1)


def _salts(level: Column, shortest: int) -> Column:
    return F.when(_length(level, shortest) >= WIDE, F.lit(SALTS)).otherwise(F.lit(1))


def _bin(x: Column, level: Column, shortest: int) -> Column:
    """Number of the bin of a position; whole numbers throughout."""
    return F.floor(x / _length(level, shortest)).cast("long")


def plain(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the columns ``names`` as the one element of an array that is exploded.

    Conditions on them stay above: Spark would write them out in terms of what the columns are made of, again for each mention, and move
    them into a join's condition or below an aggregation, where functions grow too long to be compiled.
    """
    held = rows.withColumn("__plain", F.explode(F.array(F.struct(*names))))
    return held.select(*[F.col(f"__plain.{c}").alias(c) if c in names else F.col(c) for c in rows.columns])


def interval_join(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], sorted_left: bool = False, shortest: int = BIN, spread: int = 1, many: bool = False) -> DataFrame:
    """Pairs with equal chromosome whose closed ranges overlap.

    ``sorted_left``: the left ranges are known to be in order and not null, so nothing tests them.
    ``shortest``: length of the bins of the lowest level; fewer rows meet in short ones, but long left ranges lie in many.
    ``spread``: the bins that a right range may be as long as. With more, right rows lie in more bins (one more than ``spread`` at most), but
    fewer rows meet that do not overlap, and fewer levels are in use, so left rows are copied less often.
    ``many``: far more pairs come out than rows go in. Bins are then dealt to the session's number of shuffle partitions, which are not merged
    because their rows are few, and equal left rows are first made one, within the bins, so that needs no shuffle of its own.

    ``on`` names the chromosome columns; column names of both sides must differ. Null
    bounds match nothing.
    """
    l0, l1 = (x.cast("long") for x in left_range)
    r0, r1 = (x.cast("long") for x in right_range)
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(r1 - r0 + 1, F.lit(1)) / F.lit(shortest * spread)) / F.log2(F.lit(STEP))))).cast("int")
    a = left.withColumns({"__l0": l0, "__l1": l1})
    a = a if sorted_left else a.where("__l0 <= __l1")
    b = right.withColumns({"__r0": r0, "__r1": r1}).where("__r0 <= __r1").withColumn("__level2", level)
    # which levels the features use (eleven at most): variants go to those only
    used = b.agg(F.collect_set("__level2")).scalar()
    b = b.withColumn("__first2", _bin(F.col("__r0"), F.col("__level2"), shortest))
    b = b.withColumn("__salt2", F.explode(F.sequence(F.lit(0), _salts(F.col("__level2"), shortest) - 1)))
    b = b.withColumn("__bin2", F.explode(F.sequence("__first2", _bin(F.col("__r1"), F.col("__level2"), shortest))))
    a = a.withColumn("__levels", used).withColumn("__level", F.explode("__levels")).drop("__levels")
    a = a.withColumn("__first", _bin(F.col("__l0"), F.col("__level"), shortest))
    a = a.withColumn("__bin", F.explode(F.sequence("__first", _bin(F.col("__l1"), F.col("__level"), shortest))))
    a = a.withColumn("__salt", F.pmod(F.xxhash64("__l0"), _salts(F.col("__level"), shortest)).cast("int"))
    if many:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a = a.repartition(parts, on[0], "__level", "__bin", "__salt").dropDuplicates()
        b = b.repartition(parts, on[1], "__level2", "__bin2", "__salt2")
    meet = (F.col(on[0]) == F.col(on[1])) & (F.col("__level") == F.col("__level2")) & (F.col("__bin") == F.col("__bin2")) & (F.col("__salt") == F.col("__salt2"))
    overlap = (F.col("__l0") <= F.col("__r1")) & (F.col("__l1") >= F.col("__r0")) & (F.col("__bin") == F.greatest("__first", "__first2"))
    met = a.join(b.hint("merge"), meet & overlap)
    return met.drop("__l0", "__l1", "__r0", "__r1", "__level", "__level2", "__bin", "__bin2", "__first", "__first2", "__salt", "__salt2")


def covered(right: DataFrame, chrom: str, bounds: tuple[Column, Column], piece: int = PIECE) -> DataFrame:
    """(m_chrom, m_bin, m_start, m_end): the union of closed ranges as disjoint pieces, cut at the edges of bins of ``piece`` places.

    Of the ranges that begin at one place of a bin the longest is left before they are sorted, so a
    group has ``piece`` rows at most, however many ranges lie there.
    """
    rows = right.select(F.col(chrom).alias("m_chrom"), bounds[0].cast("long").alias("s"), bounds[1].cast("long").alias("e")).where("s <= e")
    rows = rows.withColumn("m_bin", F.explode(F.sequence(F.floor(F.col("s") / piece), F.floor(F.col("e") / piece))))
    edge = F.col("m_bin") * piece
    cut = rows.groupBy("m_chrom", "m_bin", F.greatest("s", edge).alias("m_start")).agg(F.max(F.least("e", edge + piece - 1)).alias("m_end"))
    order = Window.partitionBy("m_chrom", "m_bin").orderBy("m_start")
    before = F.max("m_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = cut.withColumn("new", F.when(F.col("m_start") <= before + 1, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(order)).groupBy("m_chrom", "m_bin", "run")
    return runs.agg(F.min("m_start").alias("m_start"), F.max("m_end").alias("m_end")).drop("run")


def gathered(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], key: list[str], to: str, sort: list[str]) -> DataFrame:
    """Each row of ``left`` with the array ``to`` of the rows of ``right`` that overlap it, in the order of ``sort``; no row for a pair.

    A bin of ``PIECE`` places has its features in one row, sorted once, of which each row of ``left`` keeps those that overlap. ``key`` is
    unique in ``left``, and ``sort`` in ``right``. Rows of ``left`` over the edge of a bin, which should be few, gather from each of their bins.
    """
    own = [*sort, *[c for c in right.columns if c not in sort and c != on[1]]]
    r0, r1 = (x.cast("long") for x in right_range)
    feats = right.select(F.col(on[1]).alias("__k"), F.struct(r0.alias("__r0"), r1.alias("__r1"), F.struct(*own).alias("x")).alias("__f")).where("__f.__r0 <= __f.__r1")
    feats = feats.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__f.__r0") / PIECE), F.floor(F.col("__f.__r1") / PIECE))))
    ordered = F.array_sort(F.collect_list(F.struct("__f.x", "__f.__r0", "__f.__r1")))
    bins = feats.groupBy("__k", "__b").agg(ordered.alias("__all")).hint("merge")
    l0, l1 = (x.cast("long") for x in left_range)
    rows = left.withColumns({"__l0": l0, "__l1": l1})
    first, last = F.floor(F.col("__l0") / PIECE), F.floor(F.col("__l1") / PIECE)
    several = F.coalesce(first < last, F.lit(False))
    meet = (F.col(on[0]) == F.col("__k")) & (F.col("__bin") == F.col("__b"))
    found = F.transform(F.filter("__all", lambda f: (F.col("__l0") <= f["__r1"]) & (F.col("__l1") >= f["__r0"]) & (F.col("__l0") <= F.col("__l1"))), lambda f: f["x"])
    one = rows.where(~several).withColumn("__bin", first).join(bins, meet, "left").select(*left.columns, found.alias(to))
    many = rows.where(several).withColumn("__bin", F.explode(F.sequence(first, last))).join(bins, meet, "left")
    sets = many.select(*key, F.coalesce(found, F.array().cast(one.schema[to].dataType)).alias(to)).groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(to)))).alias(to))
    return one.unionByName(left.join(sets, key)).withColumn(to, F.coalesce(to, F.array().cast(one.schema[to].dataType)))


def outside(left: DataFrame, pieces: DataFrame, on: str, bounds: tuple[Column, Column], key: list[str]) -> DataFrame:
    """Rows of ``left`` that overlap none of ``pieces`` (of covered()); the work does not grow with the pairs.

    ``on`` names the chromosome; ``key`` is unique. Null bounds and ranges out of order overlap nothing.
    """
    l0, l1 = (x.cast("long") for x in bounds)
    rows = left.withColumns({"__l0": l0, "__l1": l1})
    first, last = F.floor(F.col("__l0") / PIECE), F.floor(F.col("__l1") / PIECE)
    several = F.coalesce(first < last, F.lit(False))
    meet = (F.col(on) == F.col("m_chrom")) & (F.col("__bin") == F.col("m_bin")) & (F.col("__l0") <= F.col("__l1")) & (F.col("__l0") <= F.col("m_end")) & (F.col("__l1") >= F.col("m_start"))
    pieces = pieces.hint("merge")
    one = rows.where(~several).withColumn("__bin", first).join(pieces, meet, "left_anti").drop("__bin")
    many = rows.where(several)
    hit = many.withColumn("__bin", F.explode(F.sequence(first, last))).join(pieces, meet, "left_semi").select(*key).distinct()
    return one.unionByName(many.join(hit, key, "left_anti")).drop("__l0", "__l1")


def overlap_counts(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], key: list[str]) -> DataFrame:
    """(*key, n): for each ``key`` of ``right`` the number of pairs of interval_join(), without making one.

    A range meets those that begin at or before its end less those that end before its start. Both numbers
    are running sums within bins of ``COUNTED`` places, to which the bins before in the group and the groups before are
    added: a window over places of a bin, over bins of a group and over groups, never over a chromosome's rows.
    """
    l0, l1 = (x.cast("long") for x in left_range)
    r0, r1 = (x.cast("long") for x in right_range)
    points = left.select(F.col(on[0]).alias("k"), l0.alias("l0"), l1.alias("l1")).where("l0 <= l1")
    points = points.select("k", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("l0").alias("x")), F.struct(F.lit(-1).alias("side"), F.col("l1").alias("x")))).alias("p"))
    points = points.groupBy("k", "p.side", "p.x").agg(F.count("*").alias("n"))
    asks = right.select(F.col(on[1]).alias("k"), r0.alias("r0"), r1.alias("r1"), F.struct(*key).alias("id")).where("r0 <= r1")
    asks = asks.select("k", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("r1").alias("x")), F.struct(F.lit(-1).alias("side"), (F.col("r0") - 1).alias("x")))).alias("p"), "id")
    asks = asks.select("k", "p.side", "p.x", "id")
    rows = points.withColumn("ask", F.lit(0)).unionByName(asks.withColumns({"ask": F.lit(1), "n": F.lit(0).cast("long")}), allowMissingColumns=True)
    rows = rows.where("k is not null").withColumn("bin", F.floor(F.col("x") / COUNTED))
    bins = rows.groupBy("k", "side", "bin").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("bin") / GROUP))
    ahead = lambda *by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = bins.groupBy("k", "side", "group").agg(F.sum("n").alias("n")).withColumn("far", ahead("k", "side", at="group")).drop("n")
    bins = bins.withColumn("near", ahead("k", "side", "group", at="bin")).join(groups, ["k", "side", "group"]).select("k", "side", "bin", (F.col("near") + F.col("far")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("k", "side", "bin").orderBy("x", "ask").rowsBetween(Window.unboundedPreceding, 0))
    asked = rows.withColumn("n", inner).where("ask = 1").join(bins.hint("merge"), ["k", "side", "bin"])
    return asked.groupBy(*[F.col("id")[c].alias(c) for c in key]).agg(F.sum(F.col("side") * (F.col("n") + F.col("before"))).alias("n"))
