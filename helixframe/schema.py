"""Field lists, severity table and genetic code.

Fixed values: they must equal the published output format and ontology.
"""

from __future__ import annotations

#: Fields of a packed entry in their order.
CSQ_FIELDS = """
Allele Consequence IMPACT SYMBOL Gene Feature_type Feature BIOTYPE EXON INTRON HGVSc HGVSp cDNA_position CDS_position
Protein_position Amino_acids Codons Existing_variation DISTANCE STRAND FLAGS VARIANT_CLASS SYMBOL_SOURCE HGNC_ID CANONICAL
MANE MANE_SELECT MANE_PLUS_CLINICAL TSL APPRIS CCDS ENSP SWISSPROT TREMBL UNIPARC UNIPROT_ISOFORM GENE_PHENO SIFT PolyPhen
DOMAINS miRNA HGVS_OFFSET AF AFR_AF AMR_AF EAS_AF EUR_AF SAS_AF gnomADe_AF gnomADe_AFR_AF gnomADe_AMR_AF gnomADe_ASJ_AF
gnomADe_EAS_AF gnomADe_FIN_AF gnomADe_MID_AF gnomADe_NFE_AF gnomADe_REMAINING_AF gnomADe_SAS_AF gnomADg_AF gnomADg_AFR_AF
gnomADg_AMI_AF gnomADg_AMR_AF gnomADg_ASJ_AF gnomADg_EAS_AF gnomADg_FIN_AF gnomADg_MID_AF gnomADg_NFE_AF
gnomADg_REMAINING_AF gnomADg_SAS_AF MAX_AF MAX_AF_POPS CLIN_SIG SOMATIC PHENO PUBMED MOTIF_NAME MOTIF_POS HIGH_INF_POS
MOTIF_SCORE_CHANGE TRANSCRIPTION_FACTORS
""".split()
#: Fields that a merged cache adds after UNIPROT_ISOFORM (a RefSeq cache: all but SOURCE).
MERGED_FIELDS = "REFSEQ_MATCH SOURCE REFSEQ_OFFSET GIVEN_REF USED_REF BAM_EDIT".split()

#: Sequence Ontology terms from most to least severe, with their impact.
SEVERITY = """
transcript_ablation HIGH
splice_acceptor_variant HIGH
splice_donor_variant HIGH
stop_gained HIGH
frameshift_variant HIGH
stop_lost HIGH
start_lost HIGH
transcript_amplification HIGH
feature_elongation HIGH
feature_truncation HIGH
inframe_insertion MODERATE
inframe_deletion MODERATE
missense_variant MODERATE
protein_altering_variant MODERATE
splice_donor_5th_base_variant LOW
splice_region_variant LOW
splice_donor_region_variant LOW
splice_polypyrimidine_tract_variant LOW
incomplete_terminal_codon_variant LOW
start_retained_variant LOW
stop_retained_variant LOW
synonymous_variant LOW
coding_sequence_variant MODIFIER
mature_miRNA_variant MODIFIER
5_prime_UTR_variant MODIFIER
3_prime_UTR_variant MODIFIER
non_coding_transcript_exon_variant MODIFIER
intron_variant MODIFIER
NMD_transcript_variant MODIFIER
non_coding_transcript_variant MODIFIER
coding_transcript_variant MODIFIER
upstream_gene_variant MODIFIER
downstream_gene_variant MODIFIER
TFBS_ablation MODIFIER
TFBS_amplification MODIFIER
TF_binding_site_variant MODIFIER
regulatory_region_ablation MODIFIER
regulatory_region_amplification MODIFIER
regulatory_region_variant MODIFIER
intergenic_variant MODIFIER
sequence_variant MODIFIER
"""
TERMS: list[tuple[str, str]] = [tuple(x.split()) for x in SEVERITY.split("\n") if x]
RANK = {term: k for k, (term, _) in enumerate(TERMS)}
IMPACT = dict(TERMS)

#: Amino acids of the 64 codons in TCAG order, first base slowest.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
#: Three-letter names of amino acids.
THREE = dict(x.split("=") for x in "A=Ala R=Arg N=Asn D=Asp C=Cys Q=Gln E=Glu G=Gly H=His I=Ile L=Leu K=Lys M=Met F=Phe P=Pro S=Ser T=Thr W=Trp Y=Tyr V=Val U=Sec X=Xaa *=Ter".split())

#: Order of feature types in a packed entry.
FEATURE_TYPES = ("Transcript", "RegulatoryFeature", "MotifFeature", "Intergenic")


def csq_fields(merged: bool = False, refseq: bool = False) -> list[str]:
    """80 fields; 86 for a merged cache; 85 for RefSeq."""
    at = CSQ_FIELDS.index("UNIPROT_ISOFORM") + 1
    more = MERGED_FIELDS if merged else [f for f in MERGED_FIELDS if f != "SOURCE"] if refseq else []
    return CSQ_FIELDS[:at] + more + CSQ_FIELDS[at:]
