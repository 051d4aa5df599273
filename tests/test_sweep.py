"""Numbers of overlaps and best features against plain loops, and against the engine's own entries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.api import annotate_frame, feature_counts, picked, picked_features
from helixframe.operators.sweep import best_of, overlaps_of
from helixframe.options import AnnotateOptions
from helixframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranges(spark):
    rng = random.Random(8)
    left = [(i, rng.choice("ab"), (s := rng.randrange(60_000)), s + rng.choice([0, 0, 1, 3, 700, 20_000, 40_000, -1])) for i in range(400)]
    left += [(900, "a", None, 5), (901, None, 1, 5), (902, "c", 1, 5), (903, "a", 16_383, 16_384), (904, "b", 32_768, 32_768)]
    right = [(j, rng.choice("ab"), (s := rng.randrange(-50, 60_000)), s + rng.choice([0, 5, 900, 16_384, 45_000]), rng.choice("xy"), rng.randrange(5)) for j in range(90)]
    right += [(900, "a", 9, 3, "x", 0), (901, "b", None, 7, "y", 0), (902, None, 1, 90_000, "x", 0)]
    return left, right, spark.createDataFrame(left, "i int, c string, l0 long, l1 long"), spark.createDataFrame(right, "j int, d string, r0 long, r1 long, kind string, o int")


def _of(row, right):
    _, c, l0, l1 = row
    ok = lambda a, b: a is not None and b is not None and a <= b
    return [r for r in right if c is not None and c == r[1] and ok(l0, l1) and ok(r[2], r[3]) and l0 <= r[3] and l1 >= r[2]]


def test_overlaps(ranges):
    left, right, a, b = ranges
    got = overlaps_of(a, b, ("c", "d"), (F.col("l0"), F.col("l1")), (F.col("r0"), F.col("r1")), ["i"], "kind", {"n_x": "x", "n_y": "y", "n_z": "z"}).collect()
    want = {row[0]: tuple(sum(r[4] == k for r in _of(row, right)) for k in "xyz") for row in left}
    assert len(got) == len(left) and {r.i: (r.n_x, r.n_y, r.n_z) for r in got} == want


def test_best(ranges):
    left, right, a, b = ranges
    got = best_of(a, b, ("c", "d"), (F.col("l0"), F.col("l1")), (F.col("r0"), F.col("r1")), ["i"], ["o", "kind", "j"]).collect()
    want = {row[0]: min(((r[5], r[4], r[0]) for r in _of(row, right)), default=(None, None, None)) for row in left}
    assert len(got) == len(left) and {r.i: (r.o, r.kind, r.j) for r in got} == want


def test_as_the_engine(spark):
    """The same as of the entries themselves."""
    v, tables, o = Q._numbered(spark, SF).where("start % 4 = 0"), Q._gene_tables(spark, SF), AnnotateOptions(distance=(3000, 100))
    order = ("canonical", "biotype", "length")
    rows = annotate_frame(v, tables, o).select("row_idx", "alt_no", "term", "Feature_type", "Feature", "CANONICAL", "BIOTYPE", "t_length").localCheckpoint()
    want = {r.row_idx: (r.Feature_type, r.Feature) for r in picked(rows, "pick_allele", order).collect()}
    assert {r.row_idx: (r.Feature_type, r.Feature) for r in picked_features(v, tables, o, order).collect()} == want
    counts = rows.groupBy("row_idx").agg(*[F.count(F.when(F.col("Feature_type") == k, 1)).alias(n) for n, k in (("t", "Transcript"), ("r", "RegulatoryFeature"))]).collect()
    assert {r.row_idx: (r.n_transcripts, r.n_regulatory, r.n_motif) for r in feature_counts(v, tables, o).collect()} == {r.row_idx: (r.t, r.r, 0) for r in counts}
    with pytest.raises(ValueError, match="rank"):
        picked_features(v, tables, o, ("rank",))


@pytest.mark.parametrize("name", ["engine_pick", "engine_features"])
def test_no_pair_is_made(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" not in plan and "Window" not in plan
