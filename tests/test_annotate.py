"""Hand-made transcripts, variants and files: expected answers follow from the definitions."""

from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helixframe.api import annotate, annotate_frame, register
from helixframe.functions.coding import effect, protein_notation, translate
from helixframe.functions.csq import header_fields, pack
from helixframe.functions.hgvs import shift_of
from helixframe.options import AnnotateOptions, compression_of
from helixframe.schema import IMPACT, RANK, csq_fields
from helixframe.sources import bgzf, fasta, vcf
from helixframe.sources.cache import CacheCatalog, build_cache, download, read_info, store_stats
from helixframe.streaming.incremental import annotate_arriving

# Two exons 101-160 and 201-260 of a forward gene; coding 111-160 and 201-240: 90 bases, 30 codons.
CDS = "ATG" + "GCTAAAGAAGAAGAATGGCATCTGGTTGCATACCCAGGTTCTCGTGATTGTCAATTTACTATGAACGTTGCTGCTAAACTGGAA" + "TAA"
EXON1, EXON2 = CDS[:50], CDS[50:]


def genome() -> str:
    g = ["C"] * 1000
    g[99:160] = "C" + "G" * 10 + EXON1
    g[160:200] = "GT" + "C" * 36 + "AG"
    g[200:260] = EXON2 + "G" * 20
    g[399:420] = list("CAAAAAAAAAACGTGTGTGTC")
    return "".join(g)


GENOME = genome()


def tables(spark):
    t = [("1", 101, 260, 1, "TX1", 1, "protein_coding", "ensembl", True, "G1", "SYM", "HGNC", "HGNC:1", 111, 240, [(101, 160), (201, 260)], "P,1"), ("1", 380, 440, 1, "TX2", 2, "lncRNA", "ensembl", False, "G2", None, None, "HGNC:2", None, None, [(380, 440)], None)]
    schema = "chrom string, start long, end long, strand int, stable_id string, version int, biotype string, source string, is_canonical boolean, gene_stable_id string, gene_symbol string, gene_symbol_source string, gene_hgnc_id string, cds_start long, cds_end long, exons array<struct<start:long,end:long>>, swissprot string"
    core = [("TX1", "PR1", CDS, translate(CDS)[:-1], [(2, 5, "Pfam", "PF1")])]
    core_schema = "transcript_id string, stable_id string, cds_sequence string, translation_seq string, protein_features array<struct<start:int,end:int,analysis:string,name:string>>"
    sift = [("TX1", [(2, "V", "deleterious", 0.01)], [(2, "V", "benign", 0.125)])]
    m = "array<struct<position:int,amino_acid:string,prediction:string,score:double>>"
    return {
        "transcript": spark.createDataFrame(t, schema),
        "translation_core": spark.createDataFrame(core, core_schema),
        "translation_sift": spark.createDataFrame(sift, f"transcript_id string, sift_predictions {m}, polyphen_predictions {m}"),
        "regulatory": spark.createDataFrame([("1", 20_000, 20_010, "R1", "promoter")], "chrom string, start long, end long, stable_id string, feature_type string"),
        "motif": spark.createDataFrame([("1", 20_005, 20_008, "M1", "-1", "MA1", "CTCF")], "chrom string, start long, end long, stable_id string, strand string, motif_name string, transcription_factors string"),
        "variation": spark.createDataFrame([("1", 115, 115, "rs1", "C/T", 0, "benign,likely_benign", "T:0.2", "T:0.5", "7"), ("1", 115, 115, "rs2", "C/T", 1, None, None, None, None), ("1", 402, 403, "rs3", "AA/-", 0, None, None, None, None)], "chrom string, start long, end long, variation_name string, allele_string string, failed int, clin_sig string, AFR string, EUR string, pubmed string"),
    }


def variants(spark, rows):
    return spark.createDataFrame([(k, 0, f"chr{c}", c, p, r, a) for k, (c, p, r, a) in enumerate(rows)], "row_idx long, alt_no int, chrom string, chrom_norm string, start long, ref string, alt string")


def run(spark, tmp_path, rows, **flags):
    path = str(tmp_path / "ref.fa")
    with open(path, "w") as f:
        f.write(">1 test\n" + "\n".join(GENOME[k : k + 60] for k in range(0, len(GENOME), 60)) + "\n")
    options = AnnotateOptions(everything=True, reference_fasta=path, **flags)
    long = annotate_frame(variants(spark, rows), tables(spark), options, fasta.read_fasta(spark, path))
    out = {}
    for r in long.collect():
        out.setdefault(r.row_idx, {})[r.Feature] = r
    return out


def base(p):
    return GENOME[p - 1]


def test_transcript_terms(spark, tmp_path):
    rows = [
        ("1", 115, "C", "T"),  # GCT Ala2 -> GTT Val
        ("1", 116, "T", "A"),  # synonymous
        ("1", 111, "A", "G"),  # start
        ("1", 161, "G", "A"),  # donor
        ("1", 200, "G", "A"),  # acceptor
        ("1", 180, "C", "A"),  # intron
        ("1", 105, "G", "A"),  # 5' UTR
        ("1", 250, "G", "A"),  # 3' UTR
        ("1", 238, "T", "C"),  # stop lost: TAA -> CAA
        ("1", 115, "CT", "C"),  # frameshift
        ("1", 60, base(60), "A"),  # upstream
        ("1", 300, base(300), "A"),  # downstream, and upstream of TX2
        ("1", 20_006, "C", "A"),
        ("1", 900_000, "C", "A"),
        ("1", 100, GENOME[99:260], "C"),  # the whole transcript
    ]
    got = run(spark, tmp_path, rows)
    terms = [got[k]["TX1"].Consequence for k in range(12)]
    assert terms == [
        "missense_variant", "synonymous_variant", "start_lost", "splice_donor_variant", "splice_acceptor_variant", "intron_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "stop_lost", "frameshift_variant", "upstream_gene_variant", "downstream_gene_variant",
    ]
    one = got[0]["TX1"]
    assert (one.IMPACT, one.Codons, one.Amino_acids, one.EXON, one.cDNA_position, one.CDS_position, one.Protein_position) == ("MODERATE", "gCt/gTt", "A/V", "1/2", "15", "5", "2")
    assert (one.HGVSc, one.HGVSp, one.SIFT, one.PolyPhen, one.DOMAINS) == ("TX1.1:c.5C>T", "PR1:p.Ala2Val", "deleterious(0.01)", "benign(0.125)", "Pfam:PF1")
    assert (one.Existing_variation, one.CLIN_SIG, one.AFR_AF, one.EUR_AF, one.MAX_AF, one.MAX_AF_POPS, one.PUBMED) == ("rs1", "benign&likely_benign", "0.2", "0.5", "0.5", "EUR", "7")
    assert (one.HGNC_ID, one.CANONICAL, one.SYMBOL, one.VARIANT_CLASS, one.Allele, one.SWISSPROT) == ("HGNC:1", "YES", "SYM", "SNV", "T", "P,1")
    assert got[1]["TX1"].HGVSp == "PR1:p.Ala2%3D" and got[11]["TX2"].HGNC_ID is None
    assert (got[3]["TX1"].HGVSc, got[4]["TX1"].HGVSc, got[3]["TX1"].INTRON) == ("TX1.1:c.50+1G>A", "TX1.1:c.51-1G>A", "1/1")
    assert (got[6]["TX1"].HGVSc, got[7]["TX1"].HGVSc) == ("TX1.1:c.-6G>A", "TX1.1:c.*10G>A")
    assert got[9]["TX1"].HGVSp.startswith("PR1:p.Glu4LysfsTer")
    assert got[10]["TX1"].DISTANCE == "41" and got[11]["TX1"].DISTANCE == "40"
    assert got[12]["R1"].Consequence == "regulatory_region_variant" and (got[12]["M1"].MOTIF_POS, got[12]["M1"].MOTIF_NAME) == ("3", "MA1")
    assert got[13][None].Consequence == "intergenic_variant"
    assert got[14]["TX1"].Consequence == "transcript_ablation"


def test_deletions_over_boundaries(spark, tmp_path):
    def gone(a, b):
        return ("1", a - 1, GENOME[a - 2 : b], GENOME[a - 2])

    rows = [
        gone(109, 113),  # two bases before the start codon and the codon
        gone(110, 111),
        gone(159, 163),  # end of exon 1 and start of the intron
        gone(198, 203),  # the other end
        gone(150, 210),  # a whole intron with both neighbours
        gone(238, 240),  # the stop codon
        gone(239, 245),  # its end and what follows
        gone(235, 242),
        gone(105, 115),
        gone(101, 150),
    ]
    got = {k: v["TX1"] for k, v in run(spark, tmp_path, rows).items()}
    assert [got[k].Consequence for k in range(10)] == [
        "start_lost&5_prime_UTR_variant",
        "start_lost&5_prime_UTR_variant",
        "splice_donor_variant&coding_sequence_variant&intron_variant",
        "splice_acceptor_variant&coding_sequence_variant&intron_variant",
        "splice_acceptor_variant&splice_donor_variant&coding_sequence_variant&intron_variant",
        "stop_lost&inframe_deletion",
        "stop_lost&3_prime_UTR_variant",
        "stop_lost&3_prime_UTR_variant",
        "start_lost&5_prime_UTR_variant",
        "start_lost&5_prime_UTR_variant",
    ]
    assert all(got[k].IMPACT == "HIGH" for k in range(10))
    assert (got[0].HGVSp, got[5].HGVSp, got[6].HGVSp) == ("PR1:p.Met1?", "PR1:p.Ter30GlyextTer?", None)  # reads on into the sequence behind


def test_indexed_fasta(spark, tmp_path):
    seqs = {"chr1": "ACGTN" * 900, "2": "ac" * 13, "3": "G"}
    path = str(tmp_path / "i.fa")
    with open(path, "w") as f, open(path + ".fai", "w") as index:
        for name, seq in seqs.items():
            f.write(f">{name} some text\n")
            index.write(f"{name}\t{len(seq)}\t{f.tell()}\t60\t61\n")
            f.write("\n".join(seq[k : k + 60] for k in range(0, len(seq), 60)) + "\n")
    plain = str(tmp_path / "p.fa")
    with open(plain, "w") as f:
        f.write(open(path).read())
    both = [sorted(tuple(r) for r in fasta.read_fasta(spark, p, 100, 30, 400).collect()) for p in (path, plain)]
    assert both[0] == both[1] and len(both[0]) == 47
    assert ("1", 1, seqs["chr1"][100:230]) in both[0] and ("2", 0, "AC" * 13) in both[0]


def test_shift_and_probes(spark, tmp_path):
    rows = [("1", 400, "CA", "C"), ("1", 400, "C", "CA"), ("1", 412, "GTG", "G"), ("1", 405, "AAA", "A")]
    got = run(spark, tmp_path, rows)
    assert (got[0]["TX2"].HGVSc, got[0]["TX2"].HGVS_OFFSET) == ("TX2.2:n.31del", "9")
    assert (got[1]["TX2"].HGVSc, got[1]["TX2"].HGVS_OFFSET) == ("TX2.2:n.31dup", "10")
    assert got[2]["TX2"].HGVSc.endswith("del") and int(got[2]["TX2"].HGVS_OFFSET) == 5
    assert got[3]["TX2"].Existing_variation is None
    plain = run(spark, tmp_path, rows, shift_hgvs=False)
    assert (plain[0]["TX2"].HGVSc, plain[0]["TX2"].HGVS_OFFSET) == ("TX2.2:n.22del", None)


@pytest.mark.parametrize(
    "position, ref, alt, terms",
    [
        (5, "C", "T", ["missense_variant"]),
        (6, "T", "A", ["synonymous_variant"]),
        (3, "G", "A", ["start_lost"]),
        (4, "", "GCT", ["inframe_insertion"]),
        (4, "GCT", "", ["inframe_deletion"]),
        (5, "C", "", ["frameshift_variant"]),
        (89, "A", "G", ["stop_retained_variant"]),
        (88, "T", "C", ["stop_lost"]),
        (7, "A", "T", ["stop_gained"]),
    ],
)
def test_coding_effect(position, ref, alt, terms):
    assert CDS[position - 1 : position - 1 + len(ref)] == ref
    assert effect(CDS, position, ref, alt)["terms"] == terms


def test_partial_codon_and_start_insertion():
    assert "incomplete_terminal_codon_variant" in effect("ATGGCTAA", 8, "A", "G")["terms"]
    assert not {"start_lost", "start_retained_variant"} & set(effect(CDS, 4, "", "A")["terms"])
    assert "start_retained_variant" in effect("CTGGCTTAA", 3, "G", "A")["terms"]


def test_protein_notation():
    assert protein_notation("MAEEW*", "MAEEEW*") == "p.Glu4dup"
    assert protein_notation("MAKW*", "MAW*") == "p.Lys3del"
    assert protein_notation("MAKW*", "MAGGW*") == "p.Lys3delinsGlyGly"
    assert protein_notation("MAKW*", "MAKCW*") == "p.Lys3_Trp4insCys"
    assert protein_notation("MAKW*", "MA*") == "p.Lys3Ter"
    assert protein_notation("MAKW*", "MAKWQL*") == "p.Ter5GlnextTer2"


def test_shift_of():
    assert shift_of("CAAAAC", 1, "A", "", 1) == 3 and shift_of("CAAAAC", 4, "A", "", -1) == 3
    assert shift_of("CACACT", 1, "", "AC", 1) == 4 and shift_of("ACGT", 1, "C", "T", 1) == 0


def test_fields_and_severity():
    assert (len(csq_fields()), len(csq_fields(merged=True)), len(csq_fields(refseq=True))) == (80, 86, 85)
    assert RANK["stop_gained"] < RANK["missense_variant"] and IMPACT["intron_variant"] == "MODIFIER"


def test_options():
    for bad in ({"everything": True}, {"hgvsp": True}, {"refseq": True, "merged": True}, {"refseq": True, "gencode_basic": True}, {"gencode_basic": True, "gencode_primary": True}):
        with pytest.raises(ValueError):
            AnnotateOptions(**bad)
    o = AnnotateOptions(everything=True, reference_fasta="x", distance=(10, 20))
    assert o.resolved().hgvsc and o.resolved().max_af and o.resolved().shift_hgvs and o.flanks == (10, 20)
    assert json.loads(o.to_json())["distance"] == "10,20" and json.loads(AnnotateOptions().to_json()) == {"extended_probes": True}
    assert compression_of("a.vcf.gz", None) == "bgzf" and compression_of("a.vcf", None) == "plain"
    with pytest.raises(ValueError):
        compression_of("a.vcf", "zip")


VCF = '##fileformat=VCFv4.2\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nchr1\t115\trs1\tC\tT,A\t50\tPASS\tDP=3\tGT\t0/1\nchr1\t900000\t.\tC\tA\t.\t.\t.\tGT\t1/1\n'


def write_cache(spark, root):
    for name, rows in tables(spark).items():
        rows.write.parquet(os.path.join(root, name))


def test_block_gzip_by_ranges(spark, tmp_path):
    import random

    rng = random.Random(8)
    lines = [f"{k} " + "".join(rng.choices("acgt\t", k=rng.choice([0, 10, 300, 5000]))) for k in range(900)]
    lines[400] = "long " + "".join(rng.choices("acgt", k=300_000))
    for name, text in (("a.vcf.gz", "\n".join(lines) + "\n"), ("b.bgz", "\n".join(lines))):
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.write(bgzf.compress(text.encode()) + bgzf.EOF)
        for task in (3_000, 50_000, 1 << 24):
            assert [r[0] for r in vcf.read_lines(spark, path, task).collect()] == lines
    for name in ("c.vcf.gz", "d.bgz"):
        path = str(tmp_path / name)
        with gzip.open(path, "wt") as f:
            f.write("x\ny\n")
        assert [r[0] for r in vcf.read_lines(spark, path).collect()] == ["x", "y"]


@pytest.mark.parametrize("suffix", ["vcf", "vcf.gz", "vcf.bgz"])
def test_file_round_trip(spark, tmp_path, suffix):
    path, out = str(tmp_path / f"in.{suffix}"), str(tmp_path / f"out.{suffix}")
    with open(path, "wb") as f:
        f.write(VCF.encode() if suffix == "vcf" else bgzf.compress(VCF.encode()) + bgzf.EOF)
    write_cache(spark, str(tmp_path / "cache"))
    seen = []
    assert annotate(path, str(tmp_path / "cache"), output_vcf=out, spark=spark, check_existing=True, on_batch_written=lambda *a: seen.append(a)) == out
    raw = open(out, "rb").read()
    text = raw.decode() if suffix == "vcf" else gzip.decompress(raw).decode()
    lines = text.splitlines()
    head = [x for x in lines if x.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.2" and header_fields(head[2]) == csq_fields() and head[-1].startswith("#CHROM")
    assert len(lines) - len(head) == 3 and seen[-1] == (3, 3, 3)
    assert lines[-3].split("\t")[4] == "T" and "missense_variant" in lines[-3] and lines[-1].endswith("\tGT\t1/1")
    assert "DP=3;CSQ=T|missense_variant|MODERATE|SYM|G1|Transcript|TX1|" in lines[-3] and "|P&1|" in lines[-3]
    again = vcf.read_vcf(spark, out, ["CSQ", "DP"])
    assert [r.DP for r in again.orderBy("row_idx").collect()] == ["3", "3", None]


def test_frame_and_sql(spark, tmp_path):
    path = str(tmp_path / "in.vcf")
    open(path, "w").write(VCF)
    write_cache(spark, str(tmp_path / "cache"))
    df = annotate(path, str(tmp_path / "cache"), spark=spark, af_1kg=True)
    assert len(df.columns) >= 80 + 8 and "CSQ" not in df.columns
    assert annotate(path, str(tmp_path / "cache"), spark=spark, skip_csq=False).columns[-1] == "CSQ"
    register(spark, "annotated", df)
    rows = spark.sql("SELECT alt, most_severe_consequence, SYMBOL, AFR_AF FROM annotated ORDER BY start, alt").collect()
    assert [tuple(r) for r in rows] == [("A", "missense_variant", "SYM", None), ("T", "missense_variant", "SYM", "0.2"), ("A", "intergenic_variant", None, None)]


def test_pack_order(spark):
    rows = [(1, "RegulatoryFeature", "R", "x,y"), (1, "Transcript", "B", None), (1, "Transcript", "A", "p|q")]
    got = pack(spark.createDataFrame(rows, "k int, Feature_type string, Feature string, v string"), ["k"], ["Feature", "v"]).first().CSQ
    assert got == "A|p&q,B|,R|x&y"


def test_build_cache(spark, tmp_path):
    source = tmp_path / "src"
    (source / "22").mkdir(parents=True)
    (source / "info.txt").write_text("species\thomo_sapiens\nvariation_cols\tchr,variation_name,failed,somatic,start,end,allele_string,AF\n")
    (source / "22" / "all_vars.gz").write_bytes(gzip.compress(b"22\trs2\t.\t.\t20\t20\tA/G\tG:0.1\n22\trs1\t0\t.\t10\t.\tC/T\t.\n"))
    tables(spark)["transcript"].write.parquet(str(source / "transcript.parquet"))
    seen = []
    out = build_cache(115, str(tmp_path / "c"), local_cache=str(source), spark=spark, on_progress=lambda *a: seen.append(a))
    assert sum(n for _, n in out) == 4 and seen[-1][3] == seen[-1][4] == 2
    catalog = CacheCatalog(spark, str(tmp_path / "c/parquet/115_GRCh38_vep"))
    v = catalog.table("variation")
    assert [r.variation_name for r in v.collect()] == ["rs1", "rs2"] and v.where("end is null").count() == 0
    assert store_stats(v) == {"variants": 2, "positions": 2} and read_info(str(source))["species"] == "homo_sapiens"
    for bad in ({"cache_type": "x"}, {"fjall_zstd_level": 23}, {"fjall_dict_size_kb": -1}):
        with pytest.raises(ValueError):
            build_cache(115, str(tmp_path), local_cache=str(source), **bad)
    with pytest.raises(FileNotFoundError):
        build_cache(115, str(tmp_path), local_cache=str(tmp_path / "none"))


def test_download_resumes(tmp_path):
    calls = []

    class Reply:
        def __init__(self, data, status, short):
            self.data, self.status, self.headers = data[: len(data) - short], status, {"Content-Length": str(len(data))}

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    def opener(request, timeout):
        at = int((request.headers.get("Range") or "bytes=0-")[6:-1])
        calls.append(at)
        return Reply(b"0123456789"[at:], 206 if at else 200, 4 if not at else 0)

    to = str(tmp_path / "f")
    download("http://x", to, retries=2, wait=0, opener=opener)
    assert open(to, "rb").read() == b"0123456789" and calls == [0, 6]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    q = annotate_arriving(spark, str(tmp_path / "in"), lambda lines: vcf.parse(lines).select("chrom", "start"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.range(1).select(F.lit(1)).count() == 1
