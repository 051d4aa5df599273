"""Operators of an annotation run: known variants, numbering, coordinates, picks, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.consequence import rank


def colocated(variants: DataFrame, known: DataFrame, failed: int = 0) -> DataFrame:
    """Left join of known variants at the same place with the same alleles; failed <= N only.

    variants: c, start, ref, alt; known: k_chrom, k_start, allele_string (ref/alt/...).
    """
    good = known.where(F.col("failed") <= failed)
    alleles = F.split("allele_string", "/")
    match = (F.col("c") == F.col("k_chrom")) & (F.col("start") == F.col("k_start")) & (F.get(alleles, F.lit(0)) == F.col("ref")) & F.array_contains(F.slice(alleles, 2, 1000), F.col("alt"))
    return variants.join(good, match, "left")


def shifted_indels(variants: DataFrame, known: DataFrame, exact: DataFrame, key: list[str], reach: int = 10) -> DataFrame:
    """Indels without an exact match, with known indels whose start is within ``reach`` bases.

    Both starts fall in bins of ``reach`` bases, so it is an equi-join on neighbouring bins.
    """
    indel = F.length("ref") != F.length("alt")
    rest = variants.where(indel).join(exact.where("variation_name is not null").select(*key).distinct(), key, "left_anti")
    split = F.split("allele_string", "/")
    other = known.where(F.length(F.get(split, F.lit(0))) != F.length(F.get(split, F.lit(1)))).withColumn("__kb", F.floor(F.col("k_start") / reach))
    near = rest.withColumn("__vb", F.explode(F.array(*[F.floor(F.col("start") / reach) + d for d in (-1, 0, 1)])))
    met = near.join(other, (F.col("c") == F.col("k_chrom")) & (F.col("__vb") == F.col("__kb")) & (F.abs(F.col("start") - F.col("k_start")) <= reach))
    return met.drop("__vb", "__kb")


def exon_numbers(exons: DataFrame) -> DataFrame:
    """exon_label k/N in the reading direction, and intron_label of the intron that follows."""
    w = Window.partitionBy("transcript_id").orderBy(F.col("e_start") * F.col("strand"))
    n = F.count("*").over(Window.partitionBy("transcript_id"))
    k = F.row_number().over(w)
    label = F.concat(k.cast("string"), F.lit("/"), n.cast("string"))
    intron = F.when(k < n, F.concat(k.cast("string"), F.lit("/"), (n - 1).cast("string")))
    return exons.select("*", label.alias("exon_label"), intron.alias("intron_label"))


def exon_offsets(exons: DataFrame) -> DataFrame:
    """cdna_offset: exonic bases before each exon in the reading direction."""
    w = Window.partitionBy("transcript_id").orderBy(F.col("e_start") * F.col("strand")).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("cdna_offset", F.coalesce(F.sum(F.col("e_end") - F.col("e_start") + 1).over(w), F.lit(0)).cast("long"))


def cdna_position(position: Column, e_start: Column, e_end: Column, strand: Column, offset: Column) -> Column:
    """1-based position in the transcript of a base of an exon with ``offset`` bases before it."""
    return offset + F.when(strand == 1, position - e_start + 1).otherwise(e_end - position + 1)


def pick(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total, ascending order (nulls first); each task keeps one row of a key before the shuffle."""
    own = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*own), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col("__row")[c].alias(c) for c in own]).select(*rows.columns)


def unique_backfill(rows: DataFrame, symbol: str, identifier: str) -> DataFrame:
    """Missing identifiers of symbols that have exactly one elsewhere."""
    known = rows.groupBy(symbol).agg(F.countDistinct(identifier).alias("__n"), F.max(identifier).alias("__id")).where("__n = 1")
    return rows.join(known.select(symbol, "__id"), symbol, "left").withColumn(identifier, F.coalesce(identifier, "__id")).drop("__id")


def compare(left: DataFrame, right: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """One row for each key and field of a full outer join: verdict match, order_only, mismatch, left_only or right_only.

    Without ``fields`` those that both sides have.
    """
    fields = fields if fields is not None else [c for c in common_columns(left, right) if c not in key]
    a = left.select(*key, *[F.col(f).alias(f"__a_{f}") for f in fields], F.lit(True).alias("__in_a"))
    b = right.select(*key, *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a_{f}").cast("string").alias("a"), F.col(f"__b_{f}").cast("string").alias("b")) for f in fields]))
    long = both.select(*key, "__in_a", "__in_b", each.alias("x")).select(*key, "__in_a", "__in_b", "x.*")
    order = F.array_sort(F.split("a", "&")) == F.array_sort(F.split("b", "&"))
    verdict = F.when(F.col("__in_b").isNull(), "left_only").when(F.col("__in_a").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "match").when(order, "order_only").otherwise("mismatch")
    return long.withColumn("verdict", verdict).drop("__in_a", "__in_b")


def match_rates(compared: DataFrame) -> DataFrame:
    """Totals of each field's verdicts and the share of matches, order aside, to four places."""
    n = {v: F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("match", "order_only", "mismatch", "left_only", "right_only")}
    rows = compared.groupBy("field").agg(*n.values())
    seen = F.col("match") + F.col("order_only") + F.col("mismatch")
    return rows.withColumn("match_rate", F.when(seen > 0, F.round((F.col("match") + F.col("order_only")) / seen, 4)))


#: What a term is about. A change is named after the groups of the terms that came and went.
TERM_GROUPS = {
    "structure": "transcript_ablation transcript_amplification feature_elongation feature_truncation",
    "splicing": "splice_acceptor_variant splice_donor_variant splice_donor_5th_base_variant splice_region_variant splice_donor_region_variant splice_polypyrimidine_tract_variant",
    "start": "start_lost start_retained_variant",
    "stop": "stop_gained stop_lost stop_retained_variant",
    "frame": "frameshift_variant inframe_insertion inframe_deletion",
    "residues": "missense_variant protein_altering_variant synonymous_variant incomplete_terminal_codon_variant coding_sequence_variant coding_transcript_variant",
    "untranslated": "5_prime_UTR_variant 3_prime_UTR_variant intron_variant",
    "noncoding": "mature_miRNA_variant non_coding_transcript_exon_variant NMD_transcript_variant non_coding_transcript_variant",
    "surroundings": "upstream_gene_variant downstream_gene_variant intergenic_variant sequence_variant",
    "regulation": "TFBS_ablation TFBS_amplification TF_binding_site_variant regulatory_region_ablation regulatory_region_amplification regulatory_region_variant",
}
GROUP_OF = {term: group for group, terms in TERM_GROUPS.items() for term in terms.split()}


def only_in(a: Column, b: Column, by: str = "&") -> Column:
    """Values of the ``by``-joined list a that b does not have, sorted and joined; null lists are empty."""
    left, right = (F.split(F.coalesce(x, F.lit("")), by) for x in (a, b))
    return F.array_join(F.filter(F.array_sort(F.array_except(left, right)), lambda x: x != ""), by)


def term_change(a: Column, b: Column) -> dict[str, Column]:
    """How the &-joined term list b differs from a.

    change: same, gained, lost or replaced; groups: what the differing terms are about;
    severity: whether the most severe term of b is above (raised) or below (lowered) that of a.
    """
    gained, lost = only_in(b, a), only_in(a, b)
    about = F.create_map(*[F.lit(x) for pair in GROUP_OF.items() for x in pair])
    differ = F.filter(F.concat(F.split(gained, "&"), F.split(lost, "&")), lambda t: t != "")
    groups = F.array_join(F.array_sort(F.array_distinct(F.transform(differ, lambda t: F.coalesce(F.try_element_at(about, t), F.lit("unknown"))))), "&")
    first, second = (F.array_min(F.transform(F.split(x, "&"), rank)) for x in (a, b))
    change = F.when((gained == "") & (lost == ""), "same").when(lost == "", "gained").when(gained == "", "lost").otherwise("replaced")
    return {"change": change, "groups": groups, "severity": F.when(second < first, "raised").when(second > first, "lowered").otherwise("level")}


#: What an output field tells.
FIELD_FAMILIES = {
    "effect": "Consequence IMPACT Codons Amino_acids SIFT PolyPhen DOMAINS miRNA",
    "place": "EXON INTRON cDNA_position CDS_position Protein_position DISTANCE STRAND MOTIF_POS",
    "notation": "HGVSc HGVSp HGVS_OFFSET",
    "known": "Existing_variation CLIN_SIG SOMATIC PHENO PUBMED",
    "feature": "Allele SYMBOL Gene Feature_type Feature BIOTYPE FLAGS VARIANT_CLASS SYMBOL_SOURCE HGNC_ID CANONICAL ENSP CCDS",
}


def field_family(field: Column) -> Column:
    of = {f: family for family, fields in FIELD_FAMILIES.items() for f in fields.split()}
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), field)
    return F.coalesce(named, F.when(F.endswith(field, F.lit("AF")) | F.startswith(field, F.lit("MAX_AF")), "frequency").otherwise("other"))


def difference_kind(a: Column, b: Column) -> Column:
    """How two values of a field differ: by absence, as lists, as numbers, or altogether."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    p, q = x.try_cast("double"), y.try_cast("double")
    more, fewer = only_in(y, x) != "", only_in(x, y) != ""
    return (
        F.when(x == y, "equal")
        .when(x == "", "absent_left")
        .when(y == "", "absent_right")
        .when(~more & ~fewer, "order")
        .when(~fewer, "extended")
        .when(~more, "shortened")
        .when(F.abs(p - q) <= 1, "near_number")
        .when((p - q).isNotNull(), "number")
        .otherwise("different")
    )


def difference_counts(compared: DataFrame, key: list[str]) -> DataFrame:
    """(family, kind, n, n_variants) of rows (key, field, a, b): entries and distinct variants of each cluster."""
    rows = compared.select(*key, field_family(F.col("field")).alias("family"), difference_kind(F.col("a"), F.col("b")).alias("kind")).where("kind <> 'equal'")
    return rows.groupBy("family", "kind").agg(F.count("*").alias("n"), F.countDistinct(*key).alias("n_variants"))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Names that both frames have, in the order of the left one."""
    return [c for c in left.columns if c in set(right.columns)]
