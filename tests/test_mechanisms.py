"""Normal forms, neighbours, indexed files, ordered output, serialised features, streams and the store."""

from __future__ import annotations

import gzip
import os
import random
import shutil
import struct
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.api import annotate_frame
from helixframe.operators import nearest as near
from helixframe.operators.normalise import common_prefix, left_aligned
from helixframe.options import AnnotateOptions
from helixframe.sources import bgzf, features, indexed, storable, vcf
from helixframe.sources.cache import CacheCatalog, build_cache
from helixframe.streaming.incremental import AnnotationStore, annotate_arriving

from .test_annotate import GENOME, VCF, tables


def normal(seq, start, ref, alt):
    """One base at a time: drop equal last bases, refill from the left, then drop equal first ones."""
    while True:
        if ref and alt and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        elif not ref or not alt:
            if start == 1:
                nxt = seq[len(ref)]
                return 1, ref + nxt, alt + nxt
            start -= 1
            ref, alt = seq[start - 1] + ref, seq[start - 1] + alt
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        start, ref, alt = start + 1, ref[1:], alt[1:]
    return start, ref, alt


def test_left_aligned(spark):
    rng = random.Random(3)
    seqs = {"1": "".join(rng.choice(["AC", "A", "CAG", "T"]) * rng.randint(1, 9) for _ in range(60)), "2": "A" * 150 + "C" + "GT" * 80, "3": "TTTTTTCA"}
    rows = set()
    for c, seq in seqs.items():
        for _ in range(250):
            x, m, a, b = rng.randint(1, len(seq) - 4), rng.randint(0, 4), rng.randint(0, 3), rng.randint(0, 3)
            start = max(1, x - a)
            ref = seq[start - 1 : x + m - 1 + b]
            alt = seq[start - 1 : x - 1] + rng.choice(["", seq[x - 1 : x + rng.randint(0, 3)], "G"]) + seq[x + m - 1 : x + m - 1 + b]
            if ref and alt and ref != alt:
                rows.add((c, start, ref if rng.random() < 0.9 else ref.lower(), alt))
    rows |= {("1", 5, "A", "<DEL>"), ("1", 5, "A", "*"), ("1", 5, "AC", "AC"), ("9", 5, "AC", "A")}
    df = spark.createDataFrame(sorted(rows), "c string, start long, ref string, alt string").selectExpr("*", "c as chrom", "start as s", "ref as r", "alt as v", "1 as unit")
    chunks = spark.createDataFrame([(c, 0, s) for c, s in seqs.items()], "f_chrom string, chunk_no long, seq string")
    got = left_aligned(df, chunks, windows=(3, 7, 500))
    assert got.columns == df.columns
    want = {(c, s, r, a): (c, *normal(seqs[c], s, r.upper(), a.upper())) if a not in ("<DEL>", "*") and r != a and c != "9" else (c, s, r, a) for c, s, r, a in rows}
    found = {(r.chrom, r.s, r.r, r.v): (r.c, r.start, r.ref, r.alt) for r in got.collect()}
    assert found == want and len({v for k, v in want.items() if k[0] == "2"}) < 0.6 * len([k for k in want if k[0] == "2"])


def test_nearest(spark):
    rng = random.Random(5)
    right = [(rng.choice("123"), s := rng.randint(1, 9_000_000), s + rng.choice([0, 10, 300_000]), f"f{k:03d}") for k in range(60)] + [("1", 50, 60, "dup1"), ("1", 50, 60, "dup0"), ("1", 9, 5, "bad")]
    left = [(k, rng.choice("1234"), s := rng.randint(1, 10_000_000), s + rng.choice([0, 0, 5_000])) for k in range(300)] + [(999, "1", 70, 70), (998, "1", 40, 45)]
    l = spark.createDataFrame(left, "k long, c string, a long, z long")  # noqa: E741
    r = spark.createDataFrame(right, "rc string, s long, e long, id string")
    got = {x.k: (x.nearest_id, x.nearest_distance, x.nearest_side) for x in near.nearest(l, r, ["k"], ("c", "rc"), (F.col("a"), F.col("z")), (F.col("s"), F.col("e")), "id").collect()}
    for k, c, a, z in left:
        own = [(max(0, s - z, a - e), i, "right" if s > z else "left" if e < a else "inside") for rc, s, e, i in right if rc == c and s <= e]
        assert got[k] == ((min(own)[1], min(own)[0], min(own)[2]) if own else (None, None, None)), k


# files with an index


def _bins(start, end, shift, depth):
    level, begin = depth, ((1 << 3 * depth) - 1) // 7
    while level and start >> shift != (end - 1) >> shift:
        level, shift, begin = level - 1, shift + 3, (begin - 1) // 8
    return begin + (start >> shift)


def write_indexed(path, records, header, csi=False, block=600):
    """A file of small blocks and its index; a plain writer for tests."""
    out, offsets, text = bytearray(bgzf.block(header.encode())), [], b""
    for line in records:
        data = (line + "\n").encode()
        if text and len(text) + len(data) > block:
            out += bgzf.block(text)
            text = b""
        offsets.append((len(out) << 16 | len(text), len(out), len(text) + len(data)))
        text += data
    out += bgzf.block(text)
    ends = [o[0] for o in offsets[1:]] + [len(out) << 16]
    out += bgzf.EOF
    open(path, "wb").write(out)
    names = list(dict.fromkeys(r.split("\t")[0] for r in records))
    depth = 6 if csi else 5
    body = b""
    for name in names:
        bins, linear = {}, {}
        for line, (at, *_), end in zip(records, offsets, ends, strict=True):
            part = line.split("\t")
            if part[0] == name:
                a, z = int(part[1]) - 1, int(part[1]) - 1 + len(part[3])
                bins.setdefault(_bins(a, z, 14, depth), []).append((at, end))
                for w in range(a >> 14, ((z - 1) >> 14) + 1):
                    linear.setdefault(w, at)
        body += struct.pack("<i", len(bins))
        for b, chunks in bins.items():
            body += struct.pack("<IQi", b, min(c[0] for c in chunks), len(chunks)) if csi else struct.pack("<Ii", b, len(chunks))
            body += b"".join(struct.pack("<2Q", *c) for c in chunks)
        if not csi:
            dense, low = [], 0
            for w in range(max(linear) + 1):
                low = linear.get(w, low)
                dense.append(low)
            body += struct.pack("<i", len(dense)) + struct.pack(f"<{len(dense)}Q", *dense)
    joined = b"".join(n.encode() + b"\0" for n in names)
    columns = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined
    raw = b"CSI\x01" + struct.pack("<3i", 14, depth, len(columns)) + columns + struct.pack("<i", len(names)) + body if csi else b"TBI\x01" + struct.pack("<i", len(names)) + columns + body
    open(path + (".csi" if csi else ".tbi"), "wb").write(bgzf.compress(raw) + bgzf.EOF)
    return [o[1] for o in offsets]


HEADER = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="b">
##INFO=<ID=NOTE,Number=1,Type=String,Description="n">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
"""


@pytest.mark.parametrize("csi", [False, True])
def test_indexed_scan(spark, tmp_path, csi):
    path = str(tmp_path / "x.vcf.gz")
    rng = random.Random(1)
    rows = [(f"chr{c}", p, "A" * rng.choice([1, 1, 40_000 if p % 90 == 0 else 2])) for c in range(1, 4) for p in sorted(rng.sample(range(1, 3_000_000), 200))]
    lines = [f"{c}\t{p}\t.\t{r}\tT\t{p % 50}\tPASS\tDP={p % 7};AF=0.5,.;{'DB;' if p % 2 else ''}NOTE=x\tGT:AD\t0/1:3,4\t." for c, p, r in rows]
    places = write_indexed(path, lines, HEADER, csi)
    every = indexed.read_indexed(spark, path, task=1 << 12)
    assert every.count() == len(rows)
    assert [str(f.dataType.simpleString()) for f in every.schema["info"].dataType] == ["bigint", "array<double>", "boolean", "string"]
    first = every.orderBy("chrom", "start").first()
    assert first.info.DP == first.start % 7 and first.info.AF == [0.5, None] and first.info.DB == bool(first.start % 2) and first.qual == first.start % 50
    assert [tuple(g) for g in first.genotypes] == [("S1", "0/1", [3, 4]), ("S2", None, None)]
    wanted = every.where("chrom = 'chr2' and start between 900000 and 1200000").select("start", "info.DP")
    assert sorted(r.start for r in wanted.collect()) == sorted(p for c, p, _ in rows if c == "chr2" and 900_000 <= p <= 1_200_000)
    # blocks of other chromosomes may be broken: they are not read
    raw = bytearray(open(path, "rb").read())
    for place, (c, *_) in zip(places, rows, strict=True):
        if place != places[0] and c != "chr2" and not any(q == place and d == "chr2" for q, (d, *_) in zip(places, rows, strict=True)):
            raw[place + 18 : place + 30] = b"\xff" * 12
    open(path, "wb").write(raw)
    again = indexed.read_indexed(spark, path).where("chrom = 'chr2' and start between 900000 and 1200000")
    assert again.count() == wanted.count() > 0
    with pytest.raises(Exception, match="Error -3|zlib|invalid"):
        indexed.read_indexed(spark, path).where("chrom = 'chr1'").count()
    assert indexed.read_indexed(spark, path, info=["DP"], form=[]).schema["info"].dataType.names == ["DP"]
    with pytest.raises(Exception, match="index"):
        shutil.copy(path, tmp_path / "y.vcf.gz")
        indexed.read_indexed(spark, str(tmp_path / "y.vcf.gz")).count()


def test_ordered_output(spark, tmp_path):
    n = 5_000
    rows = spark.range(n, 0, -1, 16).selectExpr("id as row_idx", "0 as alt_no", "'1' as chrom", "id as start", "cast(null as string) as id", "'A' as ref", "'C' as alt", "1.5D as qual", "cast(null as string) as filter", "'X=1' as info", "cast(null as string) as samples", "'y' as CSQ")
    for name, scheme in (("a.vcf", ""), ("b.vcf.gz", "file://")):
        path = f"{scheme}{tmp_path}/{name}"
        seen = []
        assert vcf.write_vcf(rows, ["##h", "#CHROM"], path, None, lambda *a: seen.append(a), n) == n
        raw = (tmp_path / name).read_bytes()
        lines = (raw.decode() if not name.endswith("gz") else gzip.decompress(raw).decode()).splitlines()
        assert lines[:2] == ["##h", "#CHROM"] and [int(x.split("\t")[1]) for x in lines[2:]] == list(range(1, n + 1))
        assert sum(s[0] for s in seen) == n and seen[-1][1:] == (n, n)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.vcf", "b.vcf.gz"]
    assert vcf.write_vcf(rows.limit(0), ["#CHROM"], f"{tmp_path}/c.vcf") == 0
    assert (tmp_path / "c.vcf").read_text() == "#CHROM\n"


# serialised features

_PERL = r"""
use Storable qw(nstore store);
my $exons = [map { bless {start => $_->[0], end => $_->[1], phase => 0, stable_id => "E$_->[0]"}, 'Bio::EnsEMBL::Exon' } ([101,160],[201,260])];
my $sift = pack('a3v*', 'VEP', (0xFFFF) x 20, (0xFFFF) x 17, (1 << 14) | 10, 0xFFFF, 0xFFFF);
my $t = bless {stable_id => 'TX1', version => 3, start => 101, end => 260, strand => 1, biotype => 'protein_coding', is_canonical => 1, _gene_stable_id => 'G1', _gene_symbol => "S\x{e9}", coding_region_start => 111, coding_region_end => 240,
  _trans_exon_array => $exons, attributes => [{code => 'TSL', value => 'tsl1 (assigned)'}, {code => 'appris', value => 'principal2'}, {code => 'cds_start_NF', value => 1}, {code => 'gencode_basic', value => 1}],
  translation => bless({stable_id => 'PR1', start_exon => $exons->[0]}, 'Bio::EnsEMBL::Translation'), big => 12345678901, small => -5, float => 1.5, none => undef, long => 'x' x 300,
  _variation_effect_feature_cache => {translateable_seq => 'ATGGCTTAA', peptide => 'MA', protein_features => [{start => 1, end => 2, hseqname => 'PF1', analysis => {_display_label => 'Pfam'}}], protein_function_predictions => {sift => {matrix => $sift}}}}, 'Bio::EnsEMBL::Transcript';
my $rna = bless {stable_id => 'TX2', start => 900000, end => 1000200, strand => -1, biotype => 'lncRNA', _trans_exon_array => [{start => 900000, end => 900100}, {start => 1000000, end => 1000200}], attributes => []}, 'Bio::EnsEMBL::Transcript';
my $write = $ARGV[1] eq 'net' ? \&nstore : \&store;
$write->({'21' => [$t, $rna]}, "$ARGV[0]/1-1000000");
$write->({'21' => [$rna]}, "$ARGV[0]/1000001-2000000");
$write->({'21' => {RegulatoryFeature => [{stable_id => 'R1', start => 5, end => 9, feature_type => 'promoter'}], MotifFeature => [{stable_id => 'M1', start => 6, end => 8, strand => -1, transcription_factors => ['A', 'B']}]}}, "$ARGV[0]/1-1000000_reg");
"""


@pytest.mark.skipif(not shutil.which("perl") or subprocess.run(["perl", "-MStorable", "-e", "1"], capture_output=True).returncode != 0, reason="needs the writer of the format")
@pytest.mark.parametrize("order", ["net", "native"])
def test_serialised_features(spark, tmp_path, order):
    source = tmp_path / "src"
    (source / "21").mkdir(parents=True)
    subprocess.run(["perl", "-e", _PERL, str(source / "21"), order], check=True)
    for p in (source / "21").iterdir():
        p.with_name(p.name + ".gz").write_bytes(gzip.compress(p.read_bytes()))
    t = storable.loads((source / "21" / "1-1000000").read_bytes())["21"][0]
    assert t.kind == "Bio::EnsEMBL::Transcript" and (int(t["big"]), t["small"], float(t["float"]), t["none"], t["long"]) == (12345678901, -5, 1.5, None, "x" * 300)
    assert t["translation"]["start_exon"] is t["_trans_exon_array"][0]
    (source / "info.txt").write_text("variation_cols\tchr,variation_name,start,end,allele_string\n")
    (source / "21" / "all_vars.gz").write_bytes(gzip.compress(b"21\trs1\t10\t.\tC/T\n"))
    (source / "21" / "all_vars.gz.csi").write_bytes(bgzf.compress(b"CSI\x01 no data"))
    build_cache(115, str(tmp_path / "c"), local_cache=str(source), spark=spark)
    c = CacheCatalog(spark, str(tmp_path / "c/parquet/115_GRCh38_vep"))
    assert c.entities == ["variation", "transcript", "exon", "translation_core", "translation_sift", "regulatory", "motif"]
    assert c.table("variation").count() == 1 and c.table("regulatory").first().feature_type == "promoter" and c.table("motif").first().transcription_factors == "A&B"
    rows = {r.stable_id: r for r in c.table("transcript").collect()}
    assert len(rows) == c.table("transcript").count() == 2
    one = rows["TX1"]
    assert (one.tsl, one.appris, one.flags, one.gencode_basic, one.gencode_primary, one.version, one.cds_start, one.gene_symbol) == ("1", "P2", "cds_start_NF", True, False, 3, 111, "Sé")
    assert [r.exon_number for r in c.table("exon").where("transcript_id = 'TX2'").orderBy("start").collect()] == [2, 1]
    core = c.table("translation_core").first()
    assert (core.stable_id, core.cds_sequence, core.translation_seq) == ("PR1", "ATGGCTTAA", "MA") and [tuple(d) for d in core.protein_features] == [(1, 2, "Pfam", "PF1")]
    assert [tuple(p) for p in c.table("translation_sift").first().sift_predictions] == [(2, "V", "deleterious", 0.01)]
    v = spark.createDataFrame([(0, 0, "21", "21", 115, "C", "T")], "row_idx long, alt_no int, chrom string, chrom_norm string, start long, ref string, alt string")
    long = annotate_frame(v, {e: c.table(e) for e in c.entities}, AnnotateOptions()).where("Feature = 'TX1'").first()
    assert long.Consequence == "missense_variant" and long.SIFT == "deleterious(0.01)" and long.TSL == "1"


def test_storable_errors():
    for raw in (b"pst0\x05", b"pst0\x09\x0b", b"pst0\x05\x0b\x13", b"pst0\x05\x0b\x02\x00\x00\x00\x01"):
        with pytest.raises((ValueError, IndexError)):
            storable.loads(raw)
    assert features.prediction_matrix(None, "sift") is None
    many = np.full(40, 0xFFFF, "<u2")
    many[21] = 2 << 14 | 500
    assert features.prediction_matrix(b"VEP" + many.tobytes(), "polyphen") == [{"position": 2, "amino_acid": "C", "prediction": "benign", "score": 0.5}]


# alleles without bases, insertions at edges


def consequences(spark, rows):
    v = spark.createDataFrame([(k, 0, "chr1", "1", *r) for k, r in enumerate(rows)], "row_idx long, alt_no int, chrom string, chrom_norm string, start long, ref string, alt string, info string")
    chunks = spark.createDataFrame([("1", 0, GENOME)], "f_chrom string, chunk_no long, seq string")
    got = annotate_frame(v, tables(spark), AnnotateOptions(hgvs=True, reference_fasta="given as a table"), chunks).where("Feature = 'TX1'")
    return {r.row_idx: r for r in got.collect()}


def test_symbolic_star_and_equal_alleles(spark):
    got = consequences(spark, [(114, "G", "<DEL>", "SVTYPE=DEL;END=118"), (114, "G", "*", None), (114, "G", "G", None), (90, "G", "<DEL>", "END=300"), (90, "G", "<DUP>", "END=300"), (114, "G", "<DUP:TANDEM>", "SVLEN=6"), (114, "G", "<INS>", None), (170, "G", "G[2:100[", None), (114, "G", "<NON_REF>", None), (160, "T", "<DEL>", "END=205")])
    assert set(got) == {0, 3, 4, 5, 6, 7, 9}
    assert got[0].Consequence == "feature_truncation&coding_sequence_variant" and (got[0].Allele, got[0].VARIANT_CLASS, got[0].Codons, got[0].HGVSc) == ("deletion", "deletion", None, None)
    assert got[3].Consequence == "transcript_ablation" and got[4].Consequence == "transcript_amplification"
    assert got[5].Consequence == "feature_elongation&coding_sequence_variant" and got[5].VARIANT_CLASS == "tandem_duplication"
    assert got[6].Consequence.split("&")[0] == "feature_elongation" and got[7].Consequence == "intron_variant"
    assert got[9].Consequence == "splice_acceptor_variant&splice_donor_variant&feature_truncation&coding_sequence_variant&intron_variant" or "feature_truncation" in got[9].Consequence


def test_insertions_at_exon_edges(spark):
    last = GENOME[159]
    got = consequences(spark, [(160, last, last + "A", None), (161, "G", "GC", None), (162, "T", "TC", None), (200, "G", "GA", None), (199, "A", "AT", None)])
    assert got[0].Consequence == "frameshift_variant&splice_region_variant" and got[0].HGVSc == "TX1.1:c.50dup" and got[0].CDS_position == "50-51"
    assert got[1].Consequence.split("&")[0] == "splice_donor_variant"  # between the donor's two bases
    assert "splice_donor_variant" not in got[2].Consequence and "splice_region_variant" in got[2].Consequence
    assert got[3].Consequence == "frameshift_variant&splice_region_variant"  # before the first base of exon 2
    assert got[4].Consequence.split("&")[0] == "splice_acceptor_variant"


# streams and the store


def test_stream_replays_add_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    (tmp_path / "in" / "b.vcf.gz").write_bytes(gzip.compress(VCF.encode()))
    (tmp_path / "in" / "c.vcf.bgz").write_bytes(bgzf.compress(VCF.encode()) + bgzf.EOF)
    run = lambda: annotate_arriving(spark, str(tmp_path / "in"), lambda lines: vcf.parse(lines).select("chrom", "start"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    count = lambda: spark.read.parquet(str(tmp_path / "out")).count()
    assert count() == 6
    # as a crash between the batch's output and its commit leaves it
    for f in [*(tmp_path / "cp" / "commits").glob("[0-9]*"), *(tmp_path / "cp" / "commits").glob(".*.crc")]:
        f.unlink()
    run()
    assert count() == 6
    (tmp_path / "in" / "d.vcf").write_text(VCF)
    run()
    assert count() == 8


def test_store_merges_and_looks_up(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path / "s"), ["chrom", "start", "alt"], parts=8)
    rows = spark.range(2_000).selectExpr("concat('chr', id % 3) as chrom", "id as start", "'A' as alt", "'old' as Consequence")
    assert store.read() is None and store.lookup(chrom="chr1", start=1, alt="A") is None
    assert store.merge(rows) == list(range(8))
    new = spark.createDataFrame([("chr1", 1, "A", "new"), ("chr9", 5_000, "T", "new"), ("chr9", 5_000, "T", "new")], rows.schema)
    touched = store.merge(new)
    assert 1 <= len(touched) <= 2
    assert store.read().count() == 2_001
    assert [r.Consequence for r in store.lookup(chrom="chr1", start=1, alt="A").collect()] == ["new"]
    assert [r.Consequence for r in store.lookup(chrom="chr2", start=2, alt="A").collect()] == ["old"]
    assert store.lookup(chrom="chr2", start=2, alt="C").count() == 0
    assert len(store.lookup(chrom="chr2", start=2, alt="A").inputFiles()) == 1
    more = spark.createDataFrame([("chr9", 5_000, "T"), ("chr9", 6_000, "T")], "chrom string, start long, alt string")
    assert [r.start for r in store.missing(more).collect()] == [6_000]
    assert store.merge(new.limit(0)) == []


def test_motif_matrices_stay_below_the_join(spark):
    """Weights, their span and informative positions are worked out for each motif, not for each variant in it."""
    from helixframe.plans.queries import QUERIES

    plan = QUERIES["motif_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "change" in above and "log2" not in above.lower()


def test_probes_meet_their_own_kind_only(spark):
    """Kind and length of an indel are equalities of the join, so others at the same place make no rows; results as a plain loop gives them."""
    from helixframe.api import annotate_frame
    from helixframe.options import AnnotateOptions

    v = spark.createDataFrame([(1, 0, "chr1", 100, "AC", "A", "1"), (2, 0, "chr1", 100, "A", "ACC", "1"), (3, 0, "chr1", 300, "ACGTACGTACGTACGTACGTA", "A", "1")], "row_idx long, alt_no int, chrom string, start long, ref string, alt string, chrom_norm string")
    known = [("1", 101, 101, "one", "T/-"), ("1", 100, 101, "two", "AC/-"), ("1", 102, 101, "ins", "-/TT/G"), ("1", 102, 101, "long", "-/TTT"), ("1", 320, 339, "far", "ACGTACGTACGTACGTACGT/-"), (None, 101, 101, "lost", "T/-")]
    k = spark.createDataFrame(known, "chrom string, start long, end long, variation_name string, allele_string string").withColumn("failed", F.lit(0))
    rows = annotate_frame(v, {"variation": k}, AnnotateOptions(check_existing=True))
    assert {r.row_idx: r.Existing_variation for r in rows.collect()} == {1: "one", 2: "ins", 3: "far"}
    assert "k_probe" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_common_prefix(spark):
    """Each string is worked out once, and short and long ones give what a plain comparison gives."""
    a, b = F.concat(F.col("x"), F.col("y")), F.col("z")
    found = common_prefix(a, b, 1_000)
    assert spark.range(1).select(F.lit("").alias("x"), F.lit("").alias("y"), F.lit("").alias("z")).select(found.alias("n"))._jdf.queryExecution().analyzed().toString().splitlines()[0].count("concat(x") == 1
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AC") for _ in range(rng.randrange(6))) + "G" * rng.choice([0, 1, 9, 14, 15, 16, 17, 40, 900])
    rows = [(x := word(), word(), x + word() if rng.random() < 0.7 else word()) for _ in range(300)] + [(None, "A", "A"), ("A", "A", None), ("", "", "")]
    got = spark.createDataFrame(rows, "x string, y string, z string").select("x", "y", "z", found.alias("n")).collect()
    assert all(r.n == (0 if None in (r.x, r.z) else len(os.path.commonprefix([r.x + r.y, r.z]))) for r in got) and len(got) == 303
