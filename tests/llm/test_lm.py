import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import lm_score

from .brute import lower


def brute(rows, smoothing=lm_score.SMOOTHING):
    k1, k2 = smoothing
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, w in words.items():
        if not held[i]:
            uni.update(w)
            w = ["<s>", *w]
            bi.update(zip(w, w[1:], strict=False))
            tri.update(zip(w, w[1:], w[2:], strict=False))
    n, v, docs = sum(uni.values()), len(uni), sum(not h for h in held.values())
    out = {}
    for i, w in words.items():
        base = model = 0.0
        w = ["<s>", *w]
        for k in range(1, len(w)):
            x, h = w[k], w[k - 1]
            root = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            p = (bi[h, x] + k1 * root) / ((docs if h == "<s>" else uni[h]) + k1)
            if k > 1:
                p = (tri[w[k - 2], h, x] + k2 * p) / (bi[w[k - 2], h] + k2)
            base += math.log10(root)
            model += math.log10(p)
        out[i] = (held[i], len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, base, model)
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], abs=1e-6)


def test_scores_brute(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 300_000)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.score_held_out(df).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()])
    held = [r for r in got if r.held_out]
    # invented words make few bigrams tell anything: the gain is in all of them together
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (4, "a b " * 50_000), (5, "z"), (6, "a b"), (7, "é È")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("block", F.lit(3))
    check(lm_score.score_held_out(df).collect(), rows)
    assert lm_score.score_held_out(df.where("false")).count() == 0
    twice = lm_score.score_held_out(df.union(df.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(twice) == 14 and all(r.held_out is False for r in twice if r.doc_id is None)
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert lm_score.score_held_out(named).count() == 7


def automaton(text: list[int], held: list[int]):
    """An automaton that learnt ``text`` and can read both texts of word numbers below 7; END is 6."""
    rng = np.random.default_rng(1)
    names = rng.integers(1, 1 << 62, 7).astype(np.uint64)
    text, held = [*text, 6], [*held, 6]
    token, bounds = names[np.array(text + held)], np.array([0, len(text), len(text) + len(held)])
    totals = []
    for order in lm_score.ORDERS:
        h, last = lm_score.ngrams(token, bounds, order)
        distinct, inverse = np.unique(h, return_inverse=True)
        totals.append(np.bincount(inverse[last < len(text)], minlength=len(distinct)))
    n_words = int((totals[0] > 0).sum())
    model, word, _ = lm_score.build(token, bounds, tuple(totals), len(text), n_words, 1)
    return model, word, bounds, n_words


def test_states_are_distributions():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 5, 400).tolist()
    model, word, bounds, n_words = automaton(text, [5, 0, 5])
    assert n_words == 6
    ended = int(model.root_to[word[bounds[1] - 1]])
    reached = {model.start, 0, *model.to.tolist(), *model.root_to.tolist()}
    assert len(reached) > 20
    after_end = {s for s in reached if s == ended or model.failure[s] == ended}
    for state in reached - after_end:  # nothing is read after END
        _, weight = model.step(np.full(7, state), np.arange(7))
        assert np.exp(weight).sum() == pytest.approx(1)


def test_traversal_takes_arcs_and_failures():
    model, word, bounds, _ = automaton([0, 1, 2, 0, 1, 3], [0, 1, 4, 0])
    ids = {k: int(word[i]) for k, i in ((0, 0), (1, 1), (2, 2), (3, 5), (4, 9))}
    s = np.array([model.start])
    s, _ = model.step(s, np.array([ids[0]]))  # START 0
    s, _ = model.step(s, np.array([ids[1]]))  # 0 1
    inner = int(s[0])
    both = [(model.arc // model.words == inner) & (model.arc % model.words == ids[k]) for k in (2, 3)]
    assert all(x.sum() == 1 for x in both)
    # an unseen word: two failure arcs, to the state of 1 and to the root
    first = int(model.failure[inner])
    assert first == 1 + ids[1] and model.failure[first] == 0
    to, weight = model.step(s, np.array([ids[4]]))
    assert to[0] == 0 and weight[0] == pytest.approx(model.fall[inner] + model.fall[first] + model.root[ids[4]])


def test_pieces_of_long_texts_carry_their_state(monkeypatch):
    rng = np.random.default_rng(3)
    text, held = rng.integers(0, 5, 3000).tolist(), rng.integers(0, 6, 2000).tolist()
    model, word, bounds, _ = automaton(text, held)
    whole = []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        s, total = np.array([model.start]), 0.0
        for w in word[i:j]:
            s, p = model.step(s, np.array([w]))
            total += float(p[0])
        whole.append(total)
    for lane in (7, 512):
        monkeypatch.setattr(lm_score, "LANE", lane)
        assert model.read(word, bounds) == pytest.approx(whole)
