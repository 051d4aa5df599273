"""Variant and feature tables derived from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import chrom_norm


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that variants() makes unique: chrom, start, ref, alt, q, f."""
    k = F.col("l_orderkey")
    base = F.substr(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    mate = F.substr(F.lit("CGTA"), (k % 4 + 1).cast("int"), F.lit(1))
    no = F.col("l_linenumber")
    return _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chrom"),
        ((k * 37 + no * 11) % 1_000_000 + 1).alias("start"),
        F.when(no == 2, F.concat(base, mate)).otherwise(base).alias("ref"),
        F.when(no == 2, base).when(no == 3, F.concat(base, mate)).when(no == 4, F.concat(base, mate, base, mate)).otherwise(mate).alias("alt"),
        F.col("l_quantity").alias("q"),
        F.when(F.col("l_returnflag") == "A", "LowQ").otherwise("PASS").alias("f"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, ref, alt, qual, filter; unique on the first four."""
    rows = variant_rows(spark, sf_dir)
    return rows.groupBy("chrom", "start", "ref", "alt").agg(F.min("q").alias("qual"), F.min("f").alias("filter"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variants with c (bare chromosome) and vend (last reference base)."""
    return variants(spark, sf_dir).withColumns({"c": chrom_norm(F.col("chrom")), "vend": F.col("start") + F.length("ref") - 1})


def placed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed() without qual and filter, and not yet unique: for joins that make its rows unique themselves."""
    rows = variant_rows(spark, sf_dir).drop("q", "f")
    return rows.withColumns({"c": chrom_norm(F.col("chrom")), "vend": F.col("start") + F.length("ref") - 1})


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    start = (k * 6151) % 1_000_000 + 1
    return _read(spark, sf_dir, "part").select(
        F.concat(F.lit("TX"), F.lpad(k.cast("string"), 8, "0")).alias("stable_id"),
        (k % 22 + 1).cast("string").alias("t_chrom"),
        start.alias("t_start"),
        (start + size * 40 - 1).alias("t_end"),
        F.when(k % 2 == 0, 1).otherwise(-1).alias("strand"),
        F.col("p_name").alias("gene_symbol"),
        F.concat(F.lit("G"), "p_brand").alias("gene_stable_id"),
        F.when(F.col("p_type") == "ECONOMY", "lncRNA").otherwise("protein_coding").alias("biotype"),
        (k % 3 == 0).alias("is_canonical"),
        (start + size * 8).alias("cds_start"),
        (start + size * 32 - 1).alias("cds_end"),
        size.alias("unit"),
    )


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).withColumn("exon_number", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    begin = F.col("t_start") + (F.col("exon_number") - 1) * F.col("unit") * 10
    return t.select(F.col("stable_id").alias("transcript_id"), F.col("t_chrom").alias("e_chrom"), "exon_number", "strand", begin.alias("e_start"), (begin + F.col("unit") * 6 - 1).alias("e_end"))


def regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = (k * 9973) % 1_000_000 + 1
    kind = F.element_at(F.array(*map(F.lit, ("promoter", "enhancer", "open_chromatin_region", "CTCF_binding_site"))), (k % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "supplier").select(F.concat(F.lit("RG"), F.lpad(k.cast("string"), 6, "0")).alias("reg_id"), (k % 22 + 1).cast("string").alias("r_chrom"), start.alias("r_start"), (start + 1999).alias("r_end"), kind.alias("feature_type"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("start")
    rows = variants(spark, sf_dir).where(s % 3 == 0)
    return rows.select(
        chrom_norm(F.col("chrom")).alias("k_chrom"),
        s.alias("k_start"),
        F.concat(F.lit("rs"), s.cast("string")).alias("variation_name"),
        F.concat("ref", F.lit("/"), "alt").alias("allele_string"),
        F.when(s % 10 == 0, 1).otherwise(0).alias("failed"),
        F.when(s % 5 == 0, None).otherwise((s % 1000).cast("double") / 1000).alias("AFR"),
        (((s * 7) % 1000).cast("double") / 1000).alias("EUR"),
        F.when(s % 4 == 0, None).otherwise(((s * 3) % 1000).cast("double") / 1000).alias("gnomADe"),
    )


#: The same tables for the oracle. v has c and vend; positions carry the names used above.
SQL = """
v AS (SELECT *, substr(chrom, 4) AS c, start + length(ref) - 1 AS vend FROM (
 SELECT chrom, start, ref, alt, min(q) AS qual, min(f) AS filter FROM (
  SELECT concat('chr', CAST(1 + l_partkey % 22 AS VARCHAR)) AS chrom, 1 + (l_orderkey * 37 + l_linenumber * 11) % 1000000 AS start,
   CASE WHEN l_linenumber = 2 THEN concat(b, m) ELSE b END AS ref,
   CASE WHEN l_linenumber = 2 THEN b WHEN l_linenumber = 3 THEN concat(b, m) WHEN l_linenumber = 4 THEN concat(b, m, b, m) ELSE m END AS alt,
   l_quantity AS q, CASE WHEN l_returnflag = 'A' THEN 'LowQ' ELSE 'PASS' END AS f
  FROM (SELECT *, substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) AS b, substr('CGTA', CAST(1 + l_orderkey % 4 AS INT), 1) AS m FROM lineitem) x
 ) y GROUP BY chrom, start, ref, alt)),
t AS (SELECT concat('TX', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS stable_id, CAST(1 + p_partkey % 22 AS VARCHAR) AS t_chrom,
  1 + (p_partkey * 6151) % 1000000 AS t_start, 1 + (p_partkey * 6151) % 1000000 + p_size * 40 - 1 AS t_end,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand, p_name AS gene_symbol, concat('G', p_brand) AS gene_stable_id,
  CASE WHEN p_type = 'ECONOMY' THEN 'lncRNA' ELSE 'protein_coding' END AS biotype, p_partkey % 3 = 0 AS is_canonical,
  1 + (p_partkey * 6151) % 1000000 + p_size * 8 AS cds_start, 1 + (p_partkey * 6151) % 1000000 + p_size * 32 - 1 AS cds_end, p_size AS unit FROM part),
e AS (SELECT stable_id AS transcript_id, t_chrom AS e_chrom, n AS exon_number, strand, t_start + (n - 1) * unit * 10 AS e_start,
  t_start + (n - 1) * unit * 10 + unit * 6 - 1 AS e_end FROM t CROSS JOIN (VALUES (1), (2), (3), (4)) AS z(n)),
r AS (SELECT concat('RG', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS reg_id, CAST(1 + s_suppkey % 22 AS VARCHAR) AS r_chrom,
  1 + (s_suppkey * 9973) % 1000000 AS r_start, 1 + (s_suppkey * 9973) % 1000000 + 1999 AS r_end,
  CASE s_suppkey % 4 WHEN 0 THEN 'promoter' WHEN 1 THEN 'enhancer' WHEN 2 THEN 'open_chromatin_region' ELSE 'CTCF_binding_site' END AS feature_type FROM supplier),
k AS (SELECT c AS k_chrom, start AS k_start, concat('rs', CAST(start AS VARCHAR)) AS variation_name, concat(ref, '/', alt) AS allele_string,
  CASE WHEN start % 10 = 0 THEN 1 ELSE 0 END AS failed, CASE WHEN start % 5 = 0 THEN NULL ELSE CAST(start % 1000 AS DOUBLE) / 1000 END AS AFR,
  CAST((start * 7) % 1000 AS DOUBLE) / 1000 AS EUR, CASE WHEN start % 4 = 0 THEN NULL ELSE CAST((start * 3) % 1000 AS DOUBLE) / 1000 END AS gnomADe
  FROM v WHERE start % 3 = 0)
"""
