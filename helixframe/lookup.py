"""Annotation of one variant at a time, over a cache that stays open.

A lookup reads, of each entity, only the row groups near the variant: tables are partitioned by chromosome
and sorted by start, so a filter on both prunes folders and row groups, and the features
that can overlap one place are few. They become local tables, so the annotation itself joins
without a shuffle. What was read is kept by regions of ``REGION`` bases, the last ``KEPT`` of them.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .api import KEY, annotate_frame, picked
from .functions.alleles import chrom_norm
from .options import AnnotateOptions
from .sources.cache import CacheCatalog

REGION, KEPT = 100_000, 64
_OF_TRANSCRIPTS = ("exon", "translation_core", "translation_sift")


class Annotator:
    """``lookup("chr17:41245466:G:A")`` gives the entries of that variant, most severe first picks on request."""

    def __init__(self, cache_dir: str, spark: SparkSession | None = None, **flags):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.options = AnnotateOptions(**flags)
        if self.options.reference_fasta:
            raise ValueError("lookups are without a reference: no hgvs fields")
        self.catalog = CacheCatalog(self.spark, cache_dir)
        self._spans: dict[str, int] = {}
        self._regions: OrderedDict[tuple[str, int], dict[str, pa.Table]] = OrderedDict()

    def _longest(self, entity: str) -> int:
        """Bases from the start to the end of the longest feature, found once (two columns of a scan)."""
        if entity not in self._spans:
            rows = self.catalog.table(entity)
            end = F.col("end") if "end" in rows.columns else F.col("start")
            self._spans[entity] = int(rows.agg(F.coalesce(F.max(end - F.col("start")), F.lit(0))).first()[0])
        return self._spans[entity]

    def near(self, entity: str, chrom: str, first: int, last: int) -> DataFrame:
        """The entity's rows that touch a range; filters on chrom and start reach the files."""
        rows = self.catalog.table(entity)
        end = F.col("end") if "end" in rows.columns else F.col("start")
        names = [chrom, f"chr{chrom}"]
        return rows.where(F.col("chrom").isin(names) & (F.col("start") <= last) & (F.col("start") >= first - self._longest(entity)) & (F.coalesce(end, F.col("start")) >= first))

    def _region(self, chrom: str, number: int) -> dict[str, pa.Table]:
        key = (chrom, number)
        if key in self._regions:
            self._regions.move_to_end(key)
            return self._regions[key]
        up = max(self.options.flanks) + 100
        first, last = number * REGION + 1 - up, (number + 1) * REGION + up
        found = {e: self.near(e, chrom, first, last).toArrow() for e in self.catalog.entities if e not in _OF_TRANSCRIPTS}
        ids = sorted(set(found["transcript"].column("stable_id").to_pylist())) if "transcript" in found else []
        for e in _OF_TRANSCRIPTS:
            if e in self.catalog.entities:
                found[e] = self.catalog.table(e).where(F.col("transcript_id").isin(ids)).toArrow()
        self._regions[key] = found
        if len(self._regions) > KEPT:
            self._regions.popitem(last=False)
        return found

    def lookup(self, variant: str, pick: str | None = None) -> list[Row]:
        """Entries of ``chrom:start:ref:alt``; with ``pick`` only the best of what it names."""
        m = re.fullmatch(r"([^:]+):(\d+):([^:]+):([^:]+)", variant)
        if not m:
            raise ValueError(f"a variant is written chrom:start:ref:alt, not {variant!r}")
        chrom, start, ref, alt = m[1], int(m[2]), m[3], m[4]
        bare = chrom.removeprefix("chr")
        tables: dict[str, list[pa.Table]] = {}
        for number in range((start - 1) // REGION, (start + len(ref) - 1) // REGION + 1):
            for e, rows in self._region(bare, number).items():
                tables.setdefault(e, []).append(rows)
        local = {e: self.spark.createDataFrame(pa.concat_tables(parts)) for e, parts in tables.items()}
        if any(len(parts) > 1 for parts in tables.values()):
            local = {e: x.dropDuplicates([c for c in ("transcript_id", "stable_id", "variation_name", "start") if c in x.columns]) for e, x in local.items()}
        v = self.spark.createDataFrame([(0, 0, chrom, start, ref, alt)], "row_idx long, alt_no int, chrom string, start long, ref string, alt string")
        rows = annotate_frame(v.withColumn("chrom_norm", chrom_norm(F.col("chrom"))), local, self.options)
        rows = rows if pick is None else picked(rows, pick)
        return rows.drop("term", "t_length", *KEY).collect()
