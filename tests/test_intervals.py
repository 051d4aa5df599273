"""Interval joins, unions and counts against plain loops, and that their plans do not grow with the pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators.intervals import covered, gathered, interval_join, outside, overlap_counts
from helixframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), (s := rng.randrange(40_000)), s + rng.choice([0, 0, 1, 3, 9_000, -1])) for i in range(300)] + [(900, "a", None, 5), (901, None, 1, 5), (902, "c", 1, 5)]
    right = [(i, rng.choice("ab"), (s := rng.randrange(-50, 40_000)), s + rng.choice([0, 5, 200, 256, 1_024, 5_000, 700_000])) for i in range(120)] + [(900, "a", 9, 3), (901, "b", None, 7)]
    return left, right, spark.createDataFrame(left, "i int, c string, l0 long, l1 long"), spark.createDataFrame(right, "j int, d string, r0 long, r1 long")


def _pairs(left, right):
    ok = lambda a, b: a is not None and b is not None and a <= b
    return {(i, j) for i, c, l0, l1 in left for j, d, r0, r1 in right if c == d and ok(l0, l1) and ok(r0, r1) and l0 <= r1 and l1 >= r0}


def _at():
    return (F.col("l0"), F.col("l1")), (F.col("r0"), F.col("r1"))


def test_join(tables):
    left, right, a, b = tables
    got = [(r.i, r.j) for r in interval_join(a, b, ("c", "d"), *_at()).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(left, right)


@pytest.mark.parametrize("spread", [1, 3, 16])
def test_join_of_repeated_rows(tables, spread):
    """Equal left rows are made one within the bins, however many bins features lie in."""
    left, right, a, b = tables
    got = [(r.i, r.j) for r in interval_join(a.union(a), b, ("c", "d"), *_at(), spread=spread, many=True).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(left, right)


def test_outside(tables):
    left, right, a, b = tables
    for some in ([x for x in right if x[0] % 9 == 0 and (x[3] or 0) - (x[2] or 0) < 10_000], right):
        kept = b.where(F.col("j").isin([x[0] for x in some]))
        got = [r.i for r in outside(a, covered(kept, "d", _at()[1]), "c", _at()[0], ["i"]).collect()]
        assert sorted(got) == sorted({x[0] for x in left} - {i for i, _ in _pairs(left, some)})


def test_pieces_are_bounded(spark):
    """A place that 5,000 ranges share is one piece of each bin."""
    many = spark.range(5_000).select(F.lit("a").alias("d"), (F.col("id") % 50).alias("r0"), (F.lit(8_000) - F.col("id") % 7).alias("r1"))
    got = sorted(tuple(r) for r in covered(many, "d", (F.col("r0"), F.col("r1"))).select("m_bin", "m_start", "m_end").collect())
    assert got == [(0, 0, 4095), (1, 4096, 8000)]


def test_counts(tables):
    left, right, a, b = tables
    got = {r.j: r.n for r in overlap_counts(a, b, ("c", "d"), *_at(), ["j"]).collect()}
    want = {j: sum(p[1] == j for p in _pairs(left, right)) for j in got}
    assert got == want and set(got) == {x[0] for x in right} - {900, 901}


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["cdna_position", "cds_position", "hgvs_snv", "overlap_exon", "overlap_transcript", "overlap_flank", "overlap_regulatory"])
def test_nothing_that_grows_is_broadcast(spark, name):
    assert "BroadcastHashJoin" not in _plan(QUERIES[name](spark, SF)).split("Physical Plan")[1]


@pytest.mark.parametrize("name", ["gene_summary", "semi_transcripts", "anti_transcripts", "intergenic"])
def test_no_pair_is_made(spark, name):
    """No join of variants and features: bins of features are never expanded against those of variants."""
    assert "__bin2" not in _plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["consequence_basic", "impact", "filter_high"])
def test_pairs_are_not_moved(spark, name):
    """The interval join is the last one: exons meet transcripts below it."""
    joins = [x for x in _plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[1].splitlines() if "Join" in x]
    assert "__bin" in joins[0]


def test_gathered_against_plain(spark):
    rng = random.Random(8)
    left = [(k, rng.choice("ab"), s, s + rng.choice([0, 0, 1, 9_000, -3])) for k, s in enumerate(rng.choices(range(20_000), k=300))] + [(900, "a", 4_095, 4_096), (901, "a", None, 5), (902, None, 1, 5), (903, "z", 1, 5)]
    right = [(f"f{k:03}", rng.choice("ab"), s, s + rng.choice([0, 40, 3_000, 15_000])) for k, s in enumerate(rng.choices(range(20_000), k=200))] + [("g1", "a", 4_000, 4_095), ("g2", "a", 4_096, 4_096), ("g3", "a", 9, 3), ("g4", "b", None, 7)]
    a, b = spark.createDataFrame(left, "k long, c string, s long, e long"), spark.createDataFrame(right, "f string, fc string, fs long, fe long")
    got = gathered(a, b, ("c", "fc"), (F.col("s"), F.col("e")), (F.col("fs"), F.col("fe")), ["k"], "found", ["f"])
    want = {k: [f for f, fc, fs, fe in sorted(right) if None not in (s, fs) and c == fc and fs <= fe and s <= e and s <= fe and e >= fs] for k, c, s, e in left}
    assert got.columns == ["k", "c", "s", "e", "found"]
    assert {r.k: [x.f for x in r.found] for r in got.collect()} == want
    assert got.count() == len(left)


def test_packing_and_unions_move_no_pairs(spark):
    for name in ("csq_pack", "csq_parse_roundtrip", "feature_union"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # no window over the entries of a variant, and nothing collects them
        assert "count(1) windowspecdefinition" not in plan and "Feature_type" not in "".join(x for x in plan.splitlines() if "collect_list" in x), name


def test_severe_terms_make_few_pairs(spark):
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__r0" not in plan("most_severe")
    # variants that keep the frame do not reach the join
    assert any("% 3" in x and "frameshift" not in x for x in plan("filter_high").splitlines())


@pytest.mark.parametrize("name", ["pick_transcript", "consequence_histogram"])
def test_terms_without_pairs(spark, name):
    """Transcripts are swept in bins of places: variants and transcripts meet in no join of intervals."""
    assert "__r0" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["consequence_basic", "impact", "overlap_flank", "overlap_transcript", "overlap_regulatory"])
def test_pairs_are_compiled_and_variants_move_once(spark, name):
    """Nothing loops over a pair's exons while they are few, no aggregation moves the variants, and bins are dealt to a given number of parts."""
    plan = _plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[1]
    first = plan.split("Union")[1].split("Union")[0] if "Union" in plan else plan
    above = first.split("SortMergeJoin")[0]
    assert "exists(" not in above and "REPARTITION_BY_NUM" in plan
    assert "hashpartitioning(chrom" not in plan


def test_terms_of_many_exons(spark, tmp_path):
    """A transcript whose key stands twice has eight exons; its variants get the terms of the SQL."""
    import duckdb

    from helixframe.plans.queries import ORACLE

    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    c.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/part.parquet' UNION ALL SELECT * REPLACE (p_size % 50 + 1 AS p_size) FROM '/root/testdata/sf0.001/part.parquet' WHERE p_partkey % 3 = 0) TO '{tmp_path}/part.parquet'")
    for t in ("part", "lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t != 'supplier' else '/root/testdata/sf0.001'}/{t}.parquet'")
    df = QUERIES["consequence_basic"](spark, str(tmp_path))
    want = c.execute(ORACLE["consequence_basic"])
    order = sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in order) for r in df.collect()) == sorted(tuple(r[names.index(n)] for n in order) for r in want.fetchall())


def _above_pairs(spark, name):
    """The physical plan above the join of variants and transcripts, and the plan."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    return plan.split("SortMergeJoin")[0], plan


def test_flanks_pass_no_function(spark):
    """Entries beside transcripts are made alone: no coding effect, no intron and no other kind of feature is worked out for them."""
    _, plan = _above_pairs(spark, "engine_flanks")
    assert "_effects" not in plan and "introns" not in plan and "reg_id" not in plan


def test_structural_pairs_are_not_moved(spark, tmp_path):
    """Variants are made unique before they meet transcripts; where a transcript's id stands twice, its pairs are as well."""
    above, plan = _above_pairs(spark, "engine_structural")
    assert "Aggregate" not in above and "_effects" not in plan
    import duckdb

    from helixframe.plans.queries import ORACLE

    c, sf = duckdb.connect(), "/root/testdata/sf0.001"
    c.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet' UNION ALL SELECT * FROM '{sf}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    c.execute(f"COPY (SELECT * FROM '{sf}/part.parquet' UNION ALL SELECT * FROM '{sf}/part.parquet' WHERE p_partkey % 3 = 0) TO '{tmp_path}/part.parquet'")
    c.execute(f"COPY (SELECT * FROM '{sf}/supplier.parquet') TO '{tmp_path}/supplier.parquet'")
    for t in ("orders", "part", "lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t != 'lineitem' else sf}/{t}.parquet'")
    want = c.execute(ORACLE["engine_structural"])
    names = [d[0] for d in want.description]
    got = QUERIES["engine_structural"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["engine_coding", "engine_deletions"])
def test_coding_pairs_are_not_moved(spark, name):
    """No join stands behind that of variants and transcripts, and what the query asks of a pair is not written out in its condition."""
    above, plan = _above_pairs(spark, name)
    assert "_effects" in above
    assert max(len(x) for x in plan.splitlines() if "SortMergeJoin" in x or "Filter" in x) < 5_000
