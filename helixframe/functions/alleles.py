"""Alleles and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CODONS


def chrom_norm(chrom: Column) -> Column:
    """The name without a leading chr."""
    return F.regexp_replace(chrom, "^chr", "")


def split_alts(variants: DataFrame, alt: str = "alt") -> DataFrame:
    """One row for each alternative allele, with its number (from 0) in alt_no."""
    return variants.select("*", F.posexplode(F.split(alt, ",")).alias("alt_no", "__alt")).drop(alt).withColumnRenamed("__alt", alt)


def _shares_first(ref: Column, alt: Column) -> Column:
    return (F.length(ref) != F.length(alt)) & (F.substr(ref, F.lit(1), F.lit(1)) == F.substr(alt, F.lit(1), F.lit(1)))


def _rest(allele: Column, trim: Column) -> Column:
    left = F.when(trim, F.substr(allele, F.lit(2))).otherwise(allele)
    return F.when(left == "", F.lit("-")).otherwise(left)


def trimmed_ref(ref: Column, alt: Column) -> Column:
    """The reference allele without a first base that both alleles share; - if nothing is left."""
    return _rest(ref, _shares_first(ref, alt))


def trimmed_alt(ref: Column, alt: Column) -> Column:
    return _rest(alt, _shares_first(ref, alt))


def trimmed_start(start: Column, ref: Column, alt: Column) -> Column:
    return start + _shares_first(ref, alt).cast("long")


def trimmed_end(start: Column, ref: Column, alt: Column) -> Column:
    """Last reference base of the trimmed variant: one before its start for an insertion."""
    return start + F.length(ref) - 1


#: What symbolic alleles are called.
SYMBOLS = {"<DEL": "deletion", "<DUP:TANDEM": "tandem_duplication", "<DUP": "duplication", "<INS": "insertion", "<INV": "inversion", "<CNV": "copy_number_variation", "<CN": "copy_number_variation"}


def symbolic(alt: Column) -> Column:
    """Whether an allele is a symbol or a breakend; a short test, as filters that are pushed down repeat it."""
    return alt.rlike(r"[<\[\]]")


def symbolic_kind(alt: Column) -> Column:
    """What a symbolic allele or a breakend stands for; null for alleles spelled out in bases."""
    kind = F.when(alt.rlike(r"[\[\]]"), "chromosome_breakpoint")
    for start, name in SYMBOLS.items():
        kind = kind.when(F.startswith(alt, F.lit(start)), name)
    return kind.when(F.startswith(alt, F.lit("<")), "sequence_alteration")


def changes(ref: Column, alt: Column) -> Column:
    """Whether there is an effect to look for: not for a star, a missing allele or one that equals the reference."""
    return F.coalesce(~alt.isin("*", "<*>", "<NON_REF>", ".") & (F.upper(ref) != F.upper(alt)), F.lit(False))


def symbolic_end(start: Column, alt: Column, info: Column) -> Column:
    """Last base of a symbolic allele: INFO's END, else by SVLEN, else its first base."""
    end, size = (F.regexp_extract(info, f"(?:^|;){k}=-?([0-9]+)", 1).try_cast("long") for k in ("END", "SVLEN"))
    last = F.coalesce(end, start + size, start + 1)
    return F.when(F.startswith(alt, F.lit("<INS")) | ~F.startswith(alt, F.lit("<")), start).otherwise(F.greatest(last, start + 1))


def variant_class(ref: Column, alt: Column) -> Column:
    """SNV, substitution, indel, deletion, insertion or what a symbol stands for; null without a change."""
    return F.when(changes(ref, alt), F.coalesce(symbolic_kind(alt), _base_class(ref, alt)))


def _base_class(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    starts = F.startswith(ref, alt) | F.startswith(alt, ref)
    return F.when((a == 1) & (b == 1), "SNV").when(a == b, "substitution").when(~starts, "indel").when(a > b, "deletion").otherwise("insertion")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def codon_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])


def amino_acid(codon: Column) -> Column:
    """One letter, * for a stop, X for what is no codon."""
    return F.coalesce(F.try_element_at(codon_map(), F.upper(codon)), F.lit("X"))


def translate_sequence(s: Column) -> Column:
    """The protein of the whole codons of a sequence."""
    n = F.floor(F.length(s) / 3).cast("int")
    letters = F.transform(F.sequence(F.lit(1), n), lambda k: amino_acid(F.substr(s, k * 3 - 2, F.lit(3))))
    return F.when(n >= 1, F.array_join(letters, "")).otherwise("")
