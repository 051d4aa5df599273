"""Prefix trie, near-duplicate vectors and periodic runs against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from helixframe.llm import prefix_trie as pt
from helixframe.llm.periodic_runs import collapse, collapse_runs, detect_runs, find_runs, repeated_order
from helixframe.llm.queries import ORACLE_SQL, op11_prefix_trie, op12_vector_dups, op13_periodic_runs
from helixframe.llm.slots import SlotTable
from helixframe.llm.vector_dups import _placed, drop_near_vectors, margin, near_vectors, spherical_kmeans, unit

SF = "/root/testdata/sf0.01"
EMPTY = sha256(b"").hexdigest()


def plain_trie(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        rest = abs(c) % 20 * (1 if c >= 0 else -1)  # the remainder has the sign of c, as in SQL
        built[c] = convs.get(c - rest, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    figures = {}
    for node in sorted(members, key=len, reverse=True):
        below = [figures[k] for k in children[node]]
        own = (len(members[node]) - 1) * (len(node[-1][1].encode().split()) if node else 0)
        figures[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), *figures[node], sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


def _talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, "user" if turn % 2 == 0 else rng.choice(["bot", None]), rng.choice(["a b", "c", "", None]) if turn < 3 else rng.choice(["d d d", "e"])))
    return rows


def test_trie_against_plain(spark):
    import helixframe.llm.queries as q

    for seed, limit in ((1, 2), (2, 5), (3, None)):
        rows = _talk(seed, 150) + [(None, 0, "user", "x")]
        df = spark.createDataFrame(rows, TURNS)
        assert trie_rows(pt.prefix_trie(df, limit=limit, tasks=5)) == plain_trie(rows, rebuilt=False)
        conv = q.F.col("conv")
        got = pt.prefix_trie(df, base=conv - conv % 20, head=q.F.crc32(conv.cast("string").cast("binary")) % 4, limit=limit, tasks=3)
        assert trie_rows(got) == plain_trie(rows)


def test_trie_of_long_conversations_and_edges(spark, monkeypatch):
    monkeypatch.setattr(pt, "BUCKET", 16)
    monkeypatch.setattr(pt, "SHARD_CHAINS", 3)
    rng = random.Random(4)
    long = [("user", rng.choice("ab")) for _ in range(300)]
    rows = [(c, i, r, t) for c in (-7, 3, 41, 60) for i, (r, t) in enumerate(long[: 300 - (c > 50)])]  # one a prefix of others
    rows += [(c, 0, "user", "hot first turn") for c in range(100, 160)]
    rows += [(c, None, "user", "null turn first") for c in (9, 9, 10)] + [(9, 5, None, None), (9, 5, None, None), (10, 4, "", "")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "text as conv", "turn as n", "role as a", "1 as part")
    assert trie_rows(pt.prefix_trie(df, limit=2, tasks=7)) == plain_trie(rows, rebuilt=False)
    assert trie_rows(pt.prefix_trie(df.limit(0))) == []
    one = spark.createDataFrame([(5, 0, None, "é " * 500_000)], TURNS)
    assert trie_rows(pt.prefix_trie(one)) == plain_trie([(5, 0, None, "é " * 500_000)], rebuilt=False)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, (5000, 3))
    table = SlotTable(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert (table.slots(keys + 1) == -1).all()
    assert len(SlotTable(keys[:0]).slots(keys[:3])) == 3
    with pytest.raises(ValueError):
        SlotTable(np.zeros((2, 3), np.int64))


def test_field_arithmetic():
    rng = random.Random(2)
    a, b = ([rng.choice([0, 1, pt.P - 1, rng.randrange(pt.P)]) for _ in range(2000)] for _ in range(2))
    x, y = np.array(a), np.array(b)
    assert pt.mulmod(x, y).tolist() == [i * j % pt.P for i, j in zip(a, b, strict=True)]
    assert pt.sums(x).tolist() == [sum(a[: k + 1]) % pt.P for k in range(len(a))]
    assert pt.powers(pt.P - 5, 77).tolist() == [pow(pt.P - 5, k, pt.P) for k in range(77)]


@pytest.mark.parametrize("name,query", [("op11_prefix_trie", op11_prefix_trie), ("op12_vector_dups", op12_vector_dups)])
def test_oracles(spark, name, query):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    df = query(spark, SF)
    assert df.columns == columns
    assert sorted(tuple(r) for r in df.collect()) == want
    if name == "op11_prefix_trie":
        assert want == plain_trie(c.execute("SELECT * FROM conversations").fetchall())


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_vectors(rows, least=0.93):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, np.float32).astype(float), label)
    links = defaultdict(set)
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i].add(j)
    out = []
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def _groups(seed, n, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6 + 1, dim))
    own = rng.integers(0, len(centres), n)
    x = centres[own] + noise * rng.normal(size=(n, dim))
    return [(int(i), [float(v) for v in x[i].astype(np.float32)], int(own[i]) % 3) for i in rng.permutation(n)]


@pytest.mark.parametrize("dim,noise", [(3, 0.2), (24, 0.25), (64, 0.25)])
def test_vectors_against_plain(spark, dim, noise):
    rows = _groups(dim, 500, dim, noise)
    got = near_vectors(spark.createDataFrame(rows, VECTORS), cells=25, block=16)
    assert sorted(tuple(r) for r in got.collect()) == plain_vectors(rows)
    assert any(r[1] for r in plain_vectors(rows))


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1)]
    rows += [(10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0, 0.1], 1), (14, [-1.0, 0.0], 1), (15, [1e-38, 0.0], 1), (16, [3e38, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "vec_id + 1 as id", "'x' as n", "1 as cell")
    got = near_vectors(df, block=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_vectors(rows)
    twice = spark.createDataFrame([*rows, *rows, (None, [1.0, 0.0], 1)], VECTORS)
    again = sorted((tuple(r) for r in near_vectors(twice).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert again == [*plain_vectors(rows), (None, 0, None, True)]
    assert near_vectors(df.limit(0)).collect() == []
    kept = drop_near_vectors(df)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == {r[0] for r in plain_vectors(rows) if r[3]}


def test_hot_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(400, 16))
    rows = [(i, [float(v) for v in np.float32(x[i])], 1) for i in range(400)] + [(i, [float(v) for v in np.float32(x[0])], 1) for i in range(400, 600)]
    got = near_vectors(spark.createDataFrame(rows, VECTORS), block=64)
    assert all(r[1:] == (599, 0, r[0] == 0) for r in map(tuple, got.collect()))


@pytest.mark.parametrize("block", [None, 70])
def test_bundles_against_plain(spark, block):
    rows = _groups(8, 500, 24, 0.25)
    got = near_vectors(spark.createDataFrame(rows, VECTORS), cells=25, block=block, bundle=40)
    assert sorted(tuple(r) for r in got.collect()) == plain_vectors(rows)


@pytest.mark.parametrize("bundles", [1, 3])
def test_a_vector_goes_once_to_each_bundle(spark, bundles):
    x = np.random.default_rng(4).normal(size=(600, 64))
    centres = spherical_kmeans(unit(x), 25)
    rows = [("a", 64, i, 1, x[i].tobytes(), bundles) for i in range(600)]
    reps = spark.createDataFrame(rows, "label string, dim int, id long, n long, vec binary, bundles int")
    got = _placed(reps, 64, centres, margin(64), np.float64).select("id", "bundle", "home", "cells").collect()
    # nearly random vectors visit many cells
    assert sum(len(r.cells) for r in got) > 4 * 600
    assert len(got) == len({(r.id, r.bundle) for r in got}) <= bundles * 600
    assert sorted(r.id for r in got if r.home >= 0) == list(range(600))
    assert all(r.home in (-2, *r.cells) for r in got)


def test_margin_covers_low_dimensions():
    assert margin(3) == pytest.approx((1 - 0.93**2) ** 0.5)
    assert margin(64) < 0.6 * margin(3)


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            size = k - s + q
            if size >= max(6, 4 * q) and all(any(words[s + t] != words[s + t + z] for t in range(size - z)) for z in range(1, q)):
                out.append((s, size, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rebuilt=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if rebuilt and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(kept).hexdigest())


def test_runs_against_plain():
    rng = random.Random(1)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3])
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 50))]
        while rng.random() < 0.6:
            words += [rng.randrange(kinds) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        got = list(zip(*(x.tolist() for x in find_runs(np.array([*words, 99]))), strict=True))
        assert got == plain_runs(words), words


def test_periodic_runs_on_documents(spark):
    got = {r[0]: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(docs)
    short = [d for d in docs if len(d[1] or "") < 12_000]
    assert len(short) > 900
    assert sum(got[i][1] > 0 for i, _ in short) > 30
    for i, text in short:
        assert got[i] == plain_row(i, text)


def test_run_edges(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b", "           ", "ab " * 300_000, "a b c " * 50 + "d " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "b b b b b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_runs", "2 as start", "3 as __key")
    got = sorted((tuple(r) for r in detect_runs(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    small = [(i, t) for i, t in rows if len(t or "") < 5_000]
    assert [r for r in got if r[0] != 8] == sorted((plain_row(i, t, rebuilt=False) for i, t in small), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[1:6] for r in got if r[0] == 8] == [(1, 0, 300_000, 1, 300_000_000)]
    assert detect_runs(df.limit(0)).collect() == []
    assert repeated_order("x", 0) is None
    kept = collapse(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id in (0, 6, 8)} == {0: None, 6: "x a b", 8: "ab"}
    assert collapse_runs("p q " * 4 + "z") == "p q z"
