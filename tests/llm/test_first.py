import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import _text as T
from helixframe.llm import decontaminate as dc
from helixframe.llm import lm_score, near_dups
from helixframe.llm.decontaminate import decontaminate, find_contamination
from helixframe.llm.near_dups import drop_near_duplicates, near_duplicates
from helixframe.llm.queries import op3_decontaminate, op9_token_counts, op10_near_dups
from helixframe.llm.token_counts import count_tokens

from . import brute

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A b"), (6, "a B"), (7, "a b c d e f"), (8, "a b c d e f"), (9, "été été, x y  z\n\n q <|endoftext|> 12's")]


def docs(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_near_duplicates_brute(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op10_near_dups(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute.near_duplicates(docs(spark, "/root/testdata/sf0.01"))


def test_near_duplicates_send_no_table_through_the_driver(spark):
    """No join broadcasts, however small its tables are."""
    ran = spark._jsparkSession.sharedState().statusStore()
    plans = lambda: {(e := ran.executionsList().apply(k)).executionId(): e.physicalPlanDescription() for k in range(ran.executionsList().size())}
    before = max(plans(), default=-1)
    assert near_duplicates(frame(spark, docs(spark))).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    own = [plan for k, plan in plans().items() if k > before]
    assert any("SortMergeJoin" in plan for plan in own)
    assert not any("BroadcastExchange" in plan for plan in own)


def test_near_duplicates_chain_and_edges(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows, cur = list(EDGE), base[:]
    for k in range(60):
        cur = cur[:]
        cur[rng.randrange(200)] = f"x{k}"
        rows.append((100 + k, " ".join(cur)))
    for k in range(60):
        one = base[:]
        for _ in range(rng.randrange(1, 6)):
            one[rng.randrange(200)] = f"y{k}"
        rows.append((300 + k, " ".join(one)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_repeats_nulls_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "a b c d e f")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert near_duplicates(frame(spark, [])).count() == 0
    extra = frame(spark, rows).withColumn("component_id", F.lit(1)).withColumn("id", F.lit("z"))
    kept = drop_near_duplicates(extra)
    assert kept.columns == extra.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]
    unlike = frame(spark, [(5, "a b c d e f"), (5, "g h i j k"), (6, "a b c d e f"), (7, None), (7, None)])
    assert sorted(r.doc_id for r in drop_near_duplicates(unlike).collect()) in ([5, 7], [5, 6, 7])


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2**n letters that collide under every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomial_hashes(spark):
    one, two = thue_morse(11)
    assert len(one) == 2048 and one != two
    both = frame(spark, [(1, one), (2, two)])
    assert [(r.component_id, r.kept) for r in near_duplicates(both).orderBy("doc_id").collect()] == [(1, True), (2, True)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, [(1, one), (2, two), (3, f"{one} {two}")]), path).collect()}
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False)) for k, t in ((1, one), (2, two), (3, f"{one} {two}"))}
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][0]
    scores = lm_score.score_held_out(frame(spark, [(held, two), (held + 1, one)])).collect()
    assert {r.doc_id: r.n_known for r in scores}[held] == 1
    items = spark.createDataFrame([(7, two)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in dc.find_contamination(both, items).collect()} == {1: 0, 2: 1}


def test_decontaminate_brute(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op3_decontaminate(spark, sf).collect()}
    assert got == brute.contamination(docs(spark, sf), items)
    assert sum(x[4] for x in got.values()) > 0


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontaminate_edges(spark, block):
    items = [(1, "a b"), (2, "q"), (3, None), (4, "..."), (5, " ".join(f"w{k}" for k in range(14))), (6, "w2 w3")]
    rows = [(1, None), (2, ""), (3, "A, b; a b"), (4, "x q"), (5, " ".join(f"W{k}" for k in range(1, 13)) + " w2"), (6, "w3 w2"), (7, "a" * 100000), (7, "a b")]
    found = find_contamination(frame(spark, rows), frame(spark, items, "item_id long, text string"), block_bytes=block)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in found.collect())
    want = sorted((i, *brute.contamination([(i, t)], items)[i][:3]) for i, t in rows)
    assert [x[:4] for x in got] == want
    empty = frame(spark, [], "item_id long, text string")
    assert find_contamination(frame(spark, rows), empty).where("contaminated").count() == 0
    assert find_contamination(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    extra = frame(spark, rows).withColumn("n_hit", F.lit(5)).withColumn("k", F.lit("k"))
    left = decontaminate(extra, frame(spark, items, "item_id long, text string"))
    assert left.columns == extra.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7]


def test_decontaminate_repeated_and_unnamed_items(spark):
    rows, text = frame(spark, [(1, "x a b c y"), (2, "q r")]), "item_id string, text string"
    items = frame(spark, [("7", "a b c"), ("7", "a b c"), ("7", "a b"), (None, "b c"), ("8", "r")], text)
    for block in (16 << 20, 4):
        got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids) for r in find_contamination(rows, items, block_bytes=block).collect()}
        assert got == {1: (3, 2, ["7", None]), 2: (1, 1, ["8"])}


def test_suffix_order_is_complete():
    rng = random.Random(5)
    for _ in range(30):
        runs = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))] for _ in range(rng.randrange(1, 6))]
        number = [x for r in runs for x in r]
        left = [k for r in runs for k in range(len(r), 0, -1)]
        order, keys = dc.suffix_array(np.array(number), np.array(left), 4)
        want = sorted(range(len(number)), key=lambda c: (number[c : c + left[c]], c))
        assert order.tolist() == want and len(keys) == len(number)


def test_longest_matches_of_items(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "z w3 w4 w5 z"), (2, "w8 " + " ".join(f"W{k}" for k in range(4, 27)) + " z"), (3, None)]
    items = frame(spark, [(1, item), (2, "z z z z z z z z z z z"), (3, "none of these")], "item_id long, text string")
    got = {r.item_id: (r.length, r.item_start, r.doc_id, r.doc_start) for r in dc.longest_matches(frame(spark, rows), items).collect()}
    assert got == {"1": (23, 4, 2, 1), "2": (1, 0, 1, 0)}


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(30))
    doc = "z " + " ".join(f"w{k}" for k in range(3, 20)) + " z"
    r = find_contamination(frame(spark, [(1, doc)]), frame(spark, [(1, item)], "item_id long, text string")).first()
    assert r.longest_match == 17 and [tuple(x) for x in r.spans] == [(1, 18)]


def test_token_counts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, SF).collect()}
    for i, text in docs(spark):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024)
    rng = random.Random(2)
    alphabet = ["a", "Bc", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "12", "<|endoftext|>", "!?", "\u0085", "\x1c", "𝄞", "日本", "\r\n"]
    rows = [*EDGE, *((100 + k, "".join(rng.choices(alphabet, k=60))) for k in range(300)), (999, "ab " * 100000)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    assert count_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("one,two", [("~q`%2rokf4<_0}`u", "w&ws9y,u_<~ajaep"), ("czzicygvjcyl3a6m", "5fkqm8khfxlr5rcp")])
def test_words_that_collide_in_mixed_hashes(spark, one, two):
    both = frame(spark, [(1, one), (2, two)])
    assert [(r.component_id, r.kept) for r in near_duplicates(both).orderBy("doc_id").collect()] == [(1, True), (2, True)]
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][0]
    scores = lm_score.score_held_out(frame(spark, [(held, two), (held + 1, one)])).collect()
    assert {r.doc_id: r.n_known for r in scores}[held] == 1
    items = spark.createDataFrame([("p", one), ("q", two)], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in dc.find_contamination(both, items).collect()} == {1: (1, ["p"]), 2: (1, ["q"])} if one.isalnum() else True


def test_keys_of_many_shards_are_dealt_in_seconds():
    rng = np.random.default_rng(1)
    keys, who = rng.integers(0, 2**63, 200_000).astype(np.uint64), np.arange(200_000)
    began = time.time()
    dealt = near_dups._dealt_keys(keys, who, 100_000)
    assert time.time() - began < 5
    both = near_dups._pairs(dealt.column(1).to_pylist())
    assert sorted(zip(both[0].view(np.uint64).tolist(), both[1].tolist(), strict=True)) == sorted(zip(keys.tolist(), who.tolist(), strict=True))
    assert all((k >> 32) % 100_000 == s for s, blob in zip(dealt.column(0).to_pylist(), dealt.column(1).to_pylist(), strict=True) for k in near_dups._pairs([blob])[0].tolist())
    distinct, leaders, member, leader = near_dups._leaders(np.array([5, 3, 5, 5], np.uint64), np.array([9, 1, 4, 7]))
    assert (distinct.tolist(), leaders.tolist(), member.tolist(), leader.tolist()) == ([3, 5], [1, 4], [7, 9], [4, 4])


def test_keyed_hash_hides_what_collides():
    one, two = b"~q`%2rokf4<_0}`u", b"w&ws9y,u_<~ajaep"
    buf = np.frombuffer(one + two, np.uint8)
    plain = T.span_hash(buf, np.array([0, 16]), np.array([16, 32]))
    assert plain[0] == plain[1]  # found against the hash without a key
    for key in (b"a" * 16, b"b" * 16):
        keyed = T.span_hash(buf, np.array([0, 16]), np.array([16, 32]), key)
        assert keyed[0] != keyed[1]
