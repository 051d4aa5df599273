"""The pipeline, stage by stage against plain versions, and whole."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import packing, quality

from . import brute
from .test_pii import base
from .test_second import check_bins

SF = "/root/testdata/sf0.001"


def words(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]) + 1 if text else 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again as the driver does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_versions(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, single, clean, private, packed = stages
    assert all(x.columns == docs.columns for x in stages[:4])
    every = rows(docs)
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {i for i, s in scores.items() if s >= 0.5}
    assert set(rows(good)) == kept and 0 < len(kept) < len(every)
    near = brute.near_duplicates([(i, every[i].text) for i in kept])
    kept = {i for i in kept if near[i][2]}
    assert set(rows(single)) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination([(i, every[i].text) for i in kept], items)
    kept = {i for i in kept if not hit[i][4]}
    assert set(rows(clean)) == kept
    after = rows(private)
    assert set(after) == kept
    for i in kept:
        spans = base(every[i].text)
        assert not base(after[i].text), after[i].text
        assert spans or after[i].text == every[i].text or "[" in after[i].text
    got = packed.collect()
    check_bins(got, packing.SIZES)
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: words(after[i].text) for i in kept}


def test_run_is_the_stages(spark, monkeypatch):
    """run() hands each stage the rows that the one before it returned."""
    seen = []

    def stage(k):
        def keep(spark_, docs, sf_dir):
            seen.append((k, docs.count(), sf_dir))
            return docs.where(F.col("doc_id") % (k + 2) != 0)

        return keep

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage(k)) for k in range(3)])
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i for i in ids if i % 2 and i % 3 and i % 4}
    assert seen == [(0, len(ids), SF), (1, sum(i % 2 > 0 for i in ids), SF), (2, sum(i % 2 > 0 and i % 3 > 0 for i in ids), SF)]


def test_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, very long texts, clashing columns, empty tables."""
    text = " ".join(f"word{k}" for k in range(300))
    data = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, "a b"), (5, "x " * 200_000), (6, "mail a.b@c.org now " + text[:900])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for c in ("score", "kept", "component_id", "pii_spans", "n_hit", "k", "block", "id"):
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    single = corpus_pipeline.near_dup_stage(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "3", "4", "5", "6", "None"]
    private = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, single, str(tmp_path)).collect()}
    assert private[6].startswith("mail [EMAIL] now word0") and private[3] is None and private[5] == data[6][1]
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in packed) == sum(words(t) for _, t in data)
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), str(tmp_path)).count() == 0
