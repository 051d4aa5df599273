"""Single variants, picks and what lies behind a coding sequence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixframe.api import annotate, annotate_frame, picked
from helixframe.functions.coding import effect
from helixframe.lookup import Annotator
from helixframe.operators.intervals import interval_join
from helixframe.operators.transcripts import with_beyond
from helixframe.options import AnnotateOptions

from .test_annotate import CDS, VCF, tables, write_cache


def test_lookup(spark, tmp_path):
    write_cache(spark, str(tmp_path / "cache"))
    a = Annotator(str(tmp_path / "cache"), spark, check_existing=True, af_1kg=True)
    every = annotate_frame(spark.createDataFrame([(0, 0, "chr1", "1", 115, "C", "T")], "row_idx long, alt_no int, chrom string, chrom_norm string, start long, ref string, alt string"), {e: a.catalog.table(e) for e in a.catalog.entities}, a.options)
    want = sorted(every.drop("term", "t_length", "row_idx", "alt_no").collect(), key=str)
    assert sorted(a.lookup("chr1:115:C:T"), key=str) == want and want[0].Consequence
    (best,) = a.lookup("chr1:115:C:T", pick="pick")
    assert (best.Feature, best.Consequence) == ("TX1", "missense_variant")
    assert [r.Consequence for r in a.lookup("7:5:A:G")] == ["intergenic_variant"]
    plan = a.near("transcript", "1", 1, 500)._jdf.queryExecution().toString()
    assert all(f in plan for f in ("In(chrom", "LessThanOrEqual(start", "GreaterThanOrEqual(start"))
    for bad in ("chr1:x:A:C", "chr1:5"):
        with pytest.raises(ValueError):
            a.lookup(bad)


def entries(spark):
    rows = [
        (0, 0, "A1", "G1", "protein_coding", None, "YES", "P1", "1", "C", "intron_variant", 900),
        (0, 0, "A2", "G1", "protein_coding", "NM_1", None, "A1", "2", None, "synonymous_variant", 300),
        (0, 0, "A3", "G2", "lncRNA", None, None, None, None, None, "stop_gained", 500),
        (0, 1, "A1", "G1", "protein_coding", None, "YES", "P1", "1", "C", "missense_variant", 900),
        (1, 0, None, None, None, None, None, None, None, None, "intergenic_variant", None),
    ]
    return spark.createDataFrame(rows, "row_idx long, alt_no int, Feature string, Gene string, BIOTYPE string, MANE_SELECT string, CANONICAL string, APPRIS string, TSL string, CCDS string, term string, t_length long").withColumns({"Feature_type": F.when(F.col("Feature").isNotNull(), "Transcript"), "MANE_PLUS_CLINICAL": F.lit(None).cast("string")})


def test_picks(spark):
    long = entries(spark)
    got = lambda how, **o: sorted((r.row_idx, r.alt_no, r.Feature or "") for r in picked(long, how, **o).collect())
    assert got("pick") == [(0, 0, "A2"), (1, 0, "")]
    assert got("pick_allele") == [(0, 0, "A2"), (0, 1, "A1"), (1, 0, "")]
    assert got("per_gene") == [(0, 0, "A2"), (0, 0, "A3"), (1, 0, "")]
    assert got("pick_allele_gene") == [(0, 0, "A2"), (0, 0, "A3"), (0, 1, "A1"), (1, 0, "")]
    assert got("pick", order=("rank",)) == [(0, 0, "A3"), (1, 0, "")]
    assert got("pick", order=("canonical", "rank")) == [(0, 1, "A1"), (1, 0, "")]
    assert got("pick", order=("tsl", "length")) == [(0, 0, "A1"), (1, 0, "")]
    assert got("pick", order=("appris",)) == [(0, 0, "A1"), (1, 0, "")]
    flagged = picked(long, "pick_allele", flag=True)
    assert flagged.count() == 5 and flagged.where("PICK = '1'").count() == 3
    for bad in ({"how": "best"}, {"how": "pick", "order": ("size",)}):
        with pytest.raises(ValueError):
            picked(long, **bad)


def test_annotate_with_picks_and_normal_forms(spark, tmp_path):
    path, fasta = str(tmp_path / "in.vcf"), str(tmp_path / "r.fa")
    open(path, "w").write(VCF)
    from .test_annotate import GENOME

    open(fasta, "w").write(">1\n" + GENOME + "\n")
    write_cache(spark, str(tmp_path / "cache"))
    df = annotate(path, str(tmp_path / "cache"), spark=spark, reference_fasta=fasta, left_align=True, pick="pick_allele", flag_pick=True, long=True)
    assert df.columns[-1] == "PICK" and df.where("PICK = '1'").count() == 3
    assert annotate(path, str(tmp_path / "cache"), spark=spark, pick="pick_allele", long=True).count() == 3
    with pytest.raises(ValueError):
        annotate(path, str(tmp_path / "cache"), spark=spark, left_align=True)


def test_effects_that_read_on():
    assert effect(CDS, 89, "A", "C", "CAGTAAGG")["protein"] == "p.Ter30SerextTer2"
    assert effect(CDS, 89, "A", "C")["protein"] == "p.Ter30SerextTer?"
    lost = effect("ATGGCTGCTTAA", 5, "C", "", "CTGACC")
    assert lost["terms"] == ["frameshift_variant"] and lost["protein"] == "p.Ala2ValfsTer4"
    # the stop comes back from behind: TA|A with its last base gone
    assert "stop_retained_variant" in effect("ATGGCTTAA", 9, "A", "", "AGG")["terms"]
    assert "stop_lost" in effect("ATGGCTTAA", 9, "A", "", "CGG")["terms"]


def test_sequence_behind_the_coding_part(spark):
    genome = "".join("ACGT"[(k * k + k // 7) % 4] for k in range(200_000))
    exons = [(100, 200), (65_000, 66_000), (150_000, 150_100)]
    rows = [("F", "1", 100, 1, 110, 65_100, exons, "x"), ("R", "1", 100, -1, 65_900, 150_050, exons, "x"), ("N", "1", 100, 1, None, None, exons, None), ("E", "1", 100, 1, 110, 150_100, exons, "x")]
    t = spark.createDataFrame(rows, "stable_id string, t_chrom string, t_start long, strand int, cds_start long, cds_end long, exons array<struct<start:long,end:long>>, cds_sequence string")
    chunks = spark.createDataFrame([("1", k, genome[k * 65_536 : (k + 1) * 65_536 + 16_384]) for k in range(4)], "f_chrom string, chunk_no long, seq string")
    got = {r.stable_id: r.beyond for r in with_beyond(t, chunks).collect()}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got["F"] == genome[65_100:66_000] + genome[149_999:150_100]
    assert got["R"] == turned(genome[99:200] + genome[64_999:65_899]) and got["N"] is None and got["E"] is None


def test_wide_features_are_salted(spark):
    v = spark.range(3_000).selectExpr("'1' as c", "id * 50000 + 1 as p")
    f = spark.createDataFrame([("1", 1, 140_000_000, "all"), ("1", 5_000_000, 9_000_000, "part"), ("1", 10, 20, "small"), ("2", 1, 140_000_000, "other")], "fc string, s long, e long, id string")
    got = interval_join(v, f, ("c", "fc"), (F.col("p"), F.col("p")), (F.col("s"), F.col("e"))).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {"all": sum(k * 50_000 + 1 <= 140_000_000 for k in range(3_000)), "part": sum(5_000_000 <= k * 50_000 + 1 <= 9_000_000 for k in range(3_000))}
    assert AnnotateOptions().flanks == (5000, 5000)
