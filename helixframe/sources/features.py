"""Features of a legacy cache: region files of serialised Perl objects, one file to a task's row.

``<chrom>/<first>-<last>.gz`` holds a chromosome's transcripts with their exons and translations,
``<chrom>/<first>-<last>_reg.gz`` its regulatory features and motifs. A feature lies in each
region that it touches; of its copies one is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storable
from .bgzf import decompress

#: Residues in the order of the prediction matrices, and what their two top bits mean.
_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_PREDICTIONS = {
    "sift": ("tolerated", "deleterious", "tolerated_low_confidence", "deleterious_low_confidence"),
    "polyphen": ("probably_damaging", "possibly_damaging", "benign", "unknown"),
}
_MATRIX = "array<struct<position:int,amino_acid:string,prediction:string,score:double>>"
_RANGES = "array<struct<start:long,end:long,phase:int,stable_id:string>>"
_DOMAINS = "array<struct<start:int,end:int,analysis:string,name:string>>"
#: Columns and the keys that they come from; a translation's are under its own names.
_PLAIN = {
    "stable_id": "stable_id", "version": "version", "start": "start", "end": "end", "strand": "strand", "biotype": "biotype", "source": "_source_cache", "is_canonical": "is_canonical",
    "gene_stable_id": "_gene_stable_id", "gene_symbol": "_gene_symbol", "gene_symbol_source": "_gene_symbol_source", "gene_hgnc_id": "_gene_hgnc_id", "gene_phenotype": "_gene_phenotype",
    "cds_start": "coding_region_start", "cds_end": "coding_region_end", "ccds": "_ccds", "swissprot": "_swissprot", "trembl": "_trembl", "uniparc": "_uniparc", "uniprot_isoform": "_uniprot_isoform", "bam_edit_status": "_bam_edit_status",
}
_TYPES = {"version": "int", "start": "long", "end": "long", "strand": "int", "is_canonical": "boolean", "cds_start": "long", "cds_end": "long"}
#: Columns from a transcript's attributes, by their code.
_ATTRIBUTES = {"tsl": "TSL", "appris": "appris", "mane_select": "MANE_Select", "mane_plus_clinical": "MANE_Plus_Clinical", "ncrna_structure": "ncRNA", "gencode_basic": "gencode_basic", "gencode_primary": "gencode_primary"}
_CODING = {"protein_id": "string", "cds_sequence": "string", "translation_seq": "string", "protein_features": _DOMAINS, "sift_predictions": _MATRIX, "polyphen_predictions": _MATRIX}
TRANSCRIPT_SCHEMA = ", ".join(["chrom string", *[f"{c} {_TYPES.get(c, 'string')}" for c in _PLAIN], *[f"{c} {'boolean' if c.startswith('gencode') else 'string'}" for c in _ATTRIBUTES], "flags string", f"exons {_RANGES}", *[f"{c} {t}" for c, t in _CODING.items()]])
REGULATORY_SCHEMA = "chrom string, entity string, stable_id string, start long, end long, strand int, feature_type string, motif_name string, transcription_factors string, matrix array<array<double>>"


def prediction_matrix(raw: bytes | None, kind: str) -> list[dict] | None:
    """Predictions of each substituted residue at each position of a protein.

    Two bytes for each, low first: two bits of prediction, ten of the score in thousandths; all bits set: none.
    """
    if not raw:
        return None
    raw = raw.encode("latin-1") if isinstance(raw, str) else raw
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    body = raw[3:] if raw[:3] == b"VEP" else raw
    values = np.frombuffer(body[: len(body) // 2 * 2], "<u2")
    k = np.flatnonzero(values != 0xFFFF)
    names = _PREDICTIONS[kind]
    return [{"position": p // 20 + 1, "amino_acid": _RESIDUES[p % 20], "prediction": names[v >> 14], "score": (v & 0x3FF) / 1000} for p, v in zip(k.tolist(), values[k].tolist(), strict=True)]


def _get(x, *path):
    """What lies under a path of keys, None where it breaks off."""
    for key in path:
        x = x.get(key) if isinstance(x, dict) else None
    return x


def _text(x) -> str | None:
    x = x.decode("latin-1") if isinstance(x, bytes) else x
    return None if x in (None, "") else str(x)


def _short(attribute: str | None, prefixes: dict[str, str]) -> str | None:
    """A value such as principal2 as P2, tsl1 (with a remark) as 1."""
    for long, short in prefixes.items():
        if attribute and attribute.lower().startswith(long):
            rest = attribute[len(long) :].split(" ")[0].lstrip("_")
            return short + rest
    return attribute


def transcript_row(chrom: str, t: dict) -> dict:
    """One transcript as a row of TRANSCRIPT_SCHEMA."""
    whole = {"int", "long"}
    row: dict = {"chrom": chrom}
    for column, key in _PLAIN.items():
        v, kind = t.get(key), _TYPES.get(column, "string")
        row[column] = (None if v in (None, "") else int(v)) if kind in whole else bool(v) if kind == "boolean" else _text(v)
    codes = {a.get("code"): _text(a.get("value")) for a in t.get("attributes") or [] if isinstance(a, dict)}
    row |= {c: codes.get(code) for c, code in _ATTRIBUTES.items()}
    row |= {c: _ATTRIBUTES[c] in codes for c in _ATTRIBUTES if c.startswith("gencode")}
    row["tsl"] = _short(row["tsl"], {"tsl": ""})
    row["appris"] = _short(row["appris"], {"principal": "P", "alternative": "A"})
    row["flags"] = "&".join(f for f in ("cds_start_NF", "cds_end_NF") if f in codes) or None
    exons = [{"start": int(x["start"]), "end": int(x["end"]), "phase": None if x.get("phase") is None else int(x["phase"]), "stable_id": _text(x.get("stable_id"))} for x in t.get("_trans_exon_array") or [] if isinstance(x, dict)]
    row["exons"] = sorted(exons, key=lambda x: x["start"]) or None
    own, protein = t.get("_variation_effect_feature_cache"), t.get("translation")
    row |= dict.fromkeys(_CODING)
    if isinstance(protein, dict) or _get(own, "translateable_seq"):
        row["protein_id"] = _text(_get(protein, "stable_id")) or _text(t.get("_protein"))
        row["cds_sequence"], row["translation_seq"] = _text(_get(own, "translateable_seq")), _text(_get(own, "peptide"))
        found = _get(own, "protein_features") or []
        row["protein_features"] = [{"start": int(d["start"]), "end": int(d["end"]), "analysis": _text(_get(d, "analysis", "_display_label") or _get(d, "analysis")), "name": _text(d.get("hseqname"))} for d in found if isinstance(d, dict)]
        scores = _get(own, "protein_function_predictions") or {}
        row["sift_predictions"] = prediction_matrix(_get(scores, "sift", "matrix"), "sift")
        humvar = _get(scores, "polyphen_humvar", "matrix") or _get(scores, "polyphen", "matrix")
        row["polyphen_predictions"] = prediction_matrix(humvar, "polyphen")
    return row


def regulatory_row(chrom: str, entity: str, f: dict) -> dict:
    kind = f.get("feature_type")
    elements = _get(f, "binding_matrix", "elements")
    matrix = [[float(elements[p].get(b) or 0) for b in "ACGT"] for p in sorted(elements, key=int)] if isinstance(elements, dict) else None
    factors = f.get("transcription_factors") or f.get("_transcription_factors")
    return {
        "chrom": chrom, "entity": entity, "stable_id": _text(f.get("stable_id")), "start": int(f["start"]), "end": int(f["end"]), "strand": int(f.get("strand") or 0), "feature_type": _text(_get(kind, "name") or _get(kind, "so_name") if isinstance(kind, dict) else kind),
        "motif_name": _text(_get(f, "binding_matrix", "stable_id") or _get(f, "_binding_matrix", "stable_id") or f.get("display_label")), "transcription_factors": _text("&".join(map(str, factors)) if isinstance(factors, list) else factors), "matrix": matrix,
    }


def _transcripts(data: dict) -> Iterator[dict]:
    for chrom, own in data.items():
        for t in own if isinstance(own, list) else []:
            if isinstance(t, dict) and t.get("stable_id"):
                yield transcript_row(str(chrom), t)


def _regulatory(data: dict) -> Iterator[dict]:
    for chrom, kinds in data.items():
        for kind, entity in (("RegulatoryFeature", "regulatory"), ("MotifFeature", "motif")):
            for f in _get(kinds, kind) or []:
                yield regulatory_row(str(chrom), entity, f)


def _decoded(spark: SparkSession, folder: str, pattern: str, rows_of, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = []
                for row in rows_of(storable.loads(decompress(raw))):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("content").mapInArrow(run, schema)


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """All transcripts of a legacy cache with exons, sequences, domains and predictions (TRANSCRIPT_SCHEMA)."""
    return _decoded(spark, folder, "[0-9]*-*[0-9].gz", _transcripts, TRANSCRIPT_SCHEMA).dropDuplicates(["chrom", "stable_id", "start"])


def read_regulatory(spark: SparkSession, folder: str) -> DataFrame:
    """Its regulatory features and motifs; ``entity`` says which."""
    return _decoded(spark, folder, "[0-9]*-*[0-9]_reg.gz", _regulatory, REGULATORY_SCHEMA).dropDuplicates(["chrom", "entity", "stable_id", "start"])


def entities(transcripts: DataFrame, regulatory: DataFrame) -> dict[str, DataFrame]:
    """The cache's tables by name."""
    coding = transcripts.where("protein_id is not null or cds_sequence is not null").withColumnRenamed("stable_id", "transcript_id")
    exon = transcripts.select("chrom", F.col("stable_id").alias("transcript_id"), F.posexplode("exons").alias("k", "x"), "strand", F.size("exons").alias("n"))
    number = F.when(F.col("strand") == 1, F.col("k") + 1).otherwise(F.col("n") - F.col("k"))
    return {
        "transcript": transcripts.drop(*_CODING),
        "exon": exon.select("chrom", "transcript_id", "x.start", "x.end", "x.phase", "x.stable_id", "strand", number.alias("exon_number")),
        "translation_core": coding.select("chrom", "start", "transcript_id", F.col("protein_id").alias("stable_id"), "cds_sequence", "translation_seq", "protein_features"),
        "translation_sift": coding.where("sift_predictions is not null or polyphen_predictions is not null").select("chrom", "start", "transcript_id", "sift_predictions", "polyphen_predictions"),
        "regulatory": regulatory.where("entity = 'regulatory'").select("chrom", "stable_id", "start", "end", "strand", "feature_type"),
        "motif": regulatory.where("entity = 'motif'").select("chrom", "stable_id", "start", "end", "strand", "motif_name", "transcription_factors", "matrix"),
    }
