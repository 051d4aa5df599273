"""Normal forms of variants: alleles trimmed, insertions and deletions moved as far left as they go.

Everything is an expression or an equi-join with reference chunks, so no variant goes through
Python. Substitutions are only trimmed. An insertion or deletion (one allele is the other
without a stretch of it) moves left over the reference in front of it as long as the last base
of the stretch equals the base in front: by the longest common suffix of that reference with
and without the stretch behind it. The suffix is found by halving, so its cost grows with the
logarithm of the window. Distinct indels are moved once, however many records share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fasta

#: Bases in front of an indel that each round looks at. Those that are still moving take part in the next.
WINDOWS = (1_000, 16_000, 16_000)
#: Longest common end of two alleles.
LONGEST = (1 << 20) - 1


def common_prefix(a: Column, b: Column, longest: int) -> Column:
    """Length, up to ``longest``, of the longest common prefix of two strings.

    The strings are an array's only element, so each is worked out once, however many expressions it is made of.
    """
    sizes = [F.lit(1 << k) for k in range(longest.bit_length() - 1, -1, -1)]

    def more(s: Column, n: Column, size: Column) -> Column:
        x = F.substr(s["a"], n + 1, size)
        return n + F.when((x == F.substr(s["b"], n + 1, size)) & (F.length(x) == size), size).otherwise(0)

    def of(s: Column) -> Column:
        # short strings take the last steps only
        steps = F.when(F.least(F.length(s["a"]), F.length(s["b"])) < 16, F.array(*sizes[-4:])).otherwise(F.array(*sizes))
        differ = F.substr(s["a"], F.lit(1), F.lit(1)) != F.substr(s["b"], F.lit(1), F.lit(1))
        return F.when(differ, 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, size: more(s, n, size)))

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), F.lit(0))


def plain_alleles(ref: Column, alt: Column) -> Column:
    """Whether both alleles are spelled out in bases and differ: no symbol, no star, no breakend."""
    return F.coalesce(ref.rlike("^[ACGTNacgtn]+$") & alt.rlike("^[ACGTNacgtn]+$") & (F.upper(ref) != F.upper(alt)), F.lit(False))


def _moved(indels: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """``indels`` after one round: at, unit, turn, anchor; ``open`` where more of the reference is needed.

    at: the first base of the stretch (or the base that follows an insertion); unit: the stretch;
    next: the base behind it.
    """
    rows = fasta.with_window(indels, chunks, F.col("c"), F.col("at") - window - 1, F.col("at") - 1, "win", inner=True)
    rows = rows.withColumn("win", F.when(F.col("at") > 1, F.upper("win")).otherwise(""))
    # beyond the end of the reference there is no window
    rows = rows.withColumns({"first": F.col("at") - F.length("win"), "all": F.concat("win", "unit")})
    rows = rows.where((F.col("at") == 1) | (F.length("win") == F.least(F.lit(window + 1).cast("long"), F.col("at") - 1)))
    rows = rows.withColumns({"__x": F.reverse("win"), "__y": F.reverse("all")})
    rows = rows.withColumn("k", common_prefix(F.col("__x"), F.col("__y"), window + 1)).drop("__x", "__y")
    # one base of the window stays as the anchor, unless the chromosome starts there
    rows = rows.withColumn("open", (F.col("k") == F.length("win")) & (F.col("first") > 1))
    rows = rows.withColumn("k", F.col("k") - F.col("open").cast("int"))
    end = F.length("all") - F.col("k")
    size = F.length("unit")
    new = {
        "anchor": F.substr("win", F.length("win") - F.col("k"), F.lit(1)),
        "next": F.when(F.col("k") > 0, F.substr("all", end + 1, F.lit(1))).otherwise(F.col("next")),
        "unit": F.substr("all", end - size + 1, size),
        "at": F.col("at") - F.col("k"),
    }
    return rows.withColumns(new).drop("win", "first", "all", "k")


def left_aligned(variants: DataFrame, chunks: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``variants`` (c, start, ref, alt and other columns) in normal form; alleles in upper case.

    Symbolic alleles, stars, alleles that equal the reference, and indels whose reference
    ``chunks`` lack stay as they are. One that starts the chromosome is anchored on the base behind it. A
    repeat of more than the sum of ``windows`` stops an indel there.
    """
    good = plain_alleles(F.col("ref"), F.col("alt"))
    rows = variants.withColumns({"__good": good, "__ref": F.upper("ref"), "__alt": F.upper("alt")})
    one = (F.length("__ref") == 1) & (F.length("__alt") == 1)
    whole = F.when(F.length("__ref") > F.length("__alt"), F.endswith("__ref", "__alt")).otherwise(F.endswith("__alt", "__ref"))
    # both flags follow from the key; as aggregates they are worked out once, where filters on them would be moved to the scan with all that alleles are made of
    many = rows.where(~one).groupBy("c", "start", "__ref", "__alt").agg(F.bool_and("__good").alias("good"), F.bool_and(whole).alias("whole")).where("good")
    # alleles that differ beyond one stretch: the common end goes, then the common begin but one base
    cut = many.where("not whole").withColumn("tail", common_prefix(F.reverse("__ref"), F.reverse("__alt"), LONGEST))
    cut = cut.withColumns({"r": F.substr("__ref", F.lit(1), F.length("__ref") - F.col("tail")), "a": F.substr("__alt", F.lit(1), F.length("__alt") - F.col("tail"))})
    cut = cut.withColumn("head", F.least(common_prefix(F.col("r"), F.col("a"), LONGEST), F.least(F.length("r"), F.length("a")) - 1))
    key = ["c", "start", "__ref", "__alt"]
    from_ = lambda s: F.substr(s, F.col("head") + 1, F.length(s))
    cut = cut.select(*key, (F.col("start") + F.col("head")).alias("n_start"), from_("r").alias("n_ref"), from_("a").alias("n_alt"))
    longer = F.when(F.length("__ref") > F.length("__alt"), F.col("__ref")).otherwise(F.col("__alt"))
    size = F.abs(F.length("__ref") - F.length("__alt"))
    todo = many.where("whole").select(*key, F.col("start").alias("at"), F.substr(longer, F.lit(1), size).alias("unit"), F.substr(longer, size + 1, F.lit(1)).alias("next"))
    done = None
    for k, window in enumerate(windows):
        moved = _moved(todo, chunks, window)
        ended = moved if k == len(windows) - 1 else moved.where("not open")
        done = ended if done is None else done.union(ended)
        # so near the begin of the reference none is left open, which spares the round
        todo = _moved(todo.where(F.col("at") > window + 2), chunks, window).where("open").select(*todo.columns)
    gone = F.length("__ref") > F.length("__alt")
    first = F.col("at") == 1
    shorter = F.when(first, F.col("next")).otherwise(F.col("anchor"))
    written = F.when(first, F.concat("unit", "next")).otherwise(F.concat("anchor", "unit"))
    done = done.select(*key, F.when(first, F.col("at")).otherwise(F.col("at") - 1).alias("n_start"), F.when(gone, written).otherwise(shorter).alias("n_ref"), F.when(gone, shorter).otherwise(written).alias("n_alt"))
    out = rows.join(cut.union(done), key, "left")
    new = {"start": F.coalesce("n_start", "start"), "ref": F.when(F.col("__good"), F.coalesce("n_ref", "__ref")).otherwise(F.col("ref")), "alt": F.when(F.col("__good"), F.coalesce("n_alt", "__alt")).otherwise(F.col("alt"))}
    return out.withColumns(new).select(*variants.columns)
