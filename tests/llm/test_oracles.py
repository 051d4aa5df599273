"""The oracle SQL of operators against their plain versions (the operators meet these elsewhere)."""

from __future__ import annotations

import duckdb
import pytest

from helixframe.llm.queries import ORACLE_SQL

from . import brute
from .test_lm import brute as scores
from .test_substring import brute as substrings

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n not in ("op11_prefix_trie", "op12_vector_dups")])  # those: test_third.py
def test_oracle(name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs = c.execute("SELECT doc_id, text FROM documents").fetchall()
    items = c.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {"op2_substring_dedup": lambda: substrings(docs, 100), "op3_decontaminate": lambda: brute.contamination(docs, items), "op5_lm_score": lambda: scores(docs), "op10_near_dups": lambda: brute.near_duplicates(docs)}[name]()
    got = {r[0]: tuple(r[1:]) for r in c.execute(ORACLE_SQL[name]).fetchall()}
    if name == "op5_lm_score":  # the scores are sums of logarithms, to six places
        assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
        assert all(got[k][4:] == pytest.approx(v[4:], abs=2e-6) for k, v in want.items())
    else:
        assert got == want
