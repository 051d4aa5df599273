"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes
as Parquet and hands to the next one. All but the last return the columns of documents.

In every stage an empty table gives an empty one, and columns beside id and text, whatever their
names, stay as they are (in the last they are left out); a very long text is held whole in
one task. Otherwise:

* quality: null and empty texts are scored like others, by the weight of no features; rows that repeat an id
  are scored each by its own text; a null id has no label and is scored.
* near-duplicates: null and empty texts and null ids are all kept; of rows that repeat an id one stays.
* decontamination: null and empty texts have no words and are kept; so are null ids and repeated rows.
* personal data: a null text stays null, an empty one empty; all rows stay.
* packing: null and empty texts get a row without a bin; ties of length go by id and piece; repeated
  rows and null ids are packed like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate as dc
from helixframe.llm import near_dups, packing, pii, quality
from helixframe.llm._spark import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the positive-unlabelled classifier scores below 0.5."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each near-duplicate group."""
    return near_dups.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return dc.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among the training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the near-duplicate estimate have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
