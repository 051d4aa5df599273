import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import lm_score
from helixframe.llm.substring_dedup import remove_repeats
from helixframe.llm.suffix_sort import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_long_runs():
    for s in (b"a" * 3000, b"ab" * 1500, bytes(range(256)) * 4, b"ba" * 800 + b"b" * 700, b"abracadabra" * 90):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if (w := raw[p : p + width]) in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_tables(spark, monkeypatch):
    from helixframe.llm.queries import op2_substring_dedup

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 400_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = result(op2_substring_dedup(spark, "/root/testdata/sf0.01"))
    want = brute(rows, 100)
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("hot", [100_000, 3])
def test_small_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1_500)
    rng = random.Random(hot)
    words = ["ab", "abc", "é", "xyz ", "aaaa", "q"]
    rows = [(k, "".join(rng.choices(words, k=rng.randrange(0, 40)))) for k in range(150)]
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, rows[5][1]), (203, rows[5][1]), (204, None), (205, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, width=12, gram=5, hot=hot)) == brute(rows, 12)


def test_one_passage_in_many_documents(spark):
    passage = "the licence of this text permits its use by anybody for any purpose whatever, without a fee or notice at all. "
    word = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 40)
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(word, F.lit(passage), F.reverse(word)).alias("text"))
    n = remove_repeats(df).agg(F.sum("n_removed"), F.min("n_removed"), F.max("n_removed"), F.sum((F.col("n_spans") > 0).cast("int"))).first()
    # neighbours of the passage that are alike in two documents go too
    assert n[0] >= 99_999 * len(passage) and n[1] == 0 and n[2] < len(passage) + 30 and n[3] == 99_999


def test_edges(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    rows = [(1, long), (2, long[1000:1250]), (3, long[500:560]), (3, long[500:560]), (4, long[:200]), (4, long[:200]), (None, long[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("b")).withColumn("n_bytes", F.lit(1))
    got = sorted(((r.doc_id or -1), r.n_removed, r.n_spans) for r in remove_repeats(df).collect())
    assert got == [(-1, 0, 0), (1, 150, 1), (2, 250, 1), (3, 0, 0), (3, 0, 0), (4, 200, 1), (4, 200, 1)]
    assert remove_repeats(df.where("false")).count() == 0
