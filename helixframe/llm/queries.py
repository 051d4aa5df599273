"""The registered queries opN_<name>, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language_id, lm_score, packing, pii, quality
from . import decontaminate as dc
from .near_dups import near_duplicates
from .periodic_runs import detect_runs, repeated_order
from .prefix_trie import prefix_trie
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .vector_dups import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.number_of(k, F.col("pii_base")).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score_held_out(table(spark, sf_dir, "documents"))
    # the order of a sum's terms shows in its last places
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a conversation takes the first turns of the one whose id is the multiple of 20 before it
    conv = F.col("conv")
    return prefix_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, head=F.crc32(conv.cast("string").cast("binary")) % 4)


def op12_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_runs(table(spark, sf_dir, "documents"), order=repeated_order)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_decontaminate, op4_pii, op5_lm_score, op6_language_id, op7_packing, op8_ann, op9_token_counts, op10_near_dups, op11_prefix_trie, op12_vector_dups, op13_periodic_runs)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of doc_id as text, by bytes and bits.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
_K1, _K2 = lm_score.SMOOTHING

_CRC_CONV = _CRC.replace("doc_id", "conv_id")

#: SQL for DuckDB. The other operators depend on a model, a tokenizer or an order of packing.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5(raw[p : p + 99]) AS h FROM (SELECT doc_id, raw, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100) x),
again AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) y WHERE k > 1),
run AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g
 FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again) a1) a2 GROUP BY doc_id, g),
gap AS (SELECT doc_id, z AS after, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS upto FROM (SELECT doc_id, a, z FROM run UNION ALL SELECT doc_id, 0, 0 FROM d) r),
kept AS (SELECT doc_id, string_agg(hex(raw[after + 1 : coalesce(upto - 1, n)]), '' ORDER BY after) AS x FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
s AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op3_decontaminate": f"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0) x),
dwin AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) z WHERE len(w) >= n) y),
hit AS MATERIALIZED (SELECT doc_id, s, n, item_id FROM dwin JOIN win USING (k, n)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) h GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op5_lm_score": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_CRC} % 5 = 1 AS held, list_append(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, held, x, lag(x, 1, '') OVER q AS h, lag(x, 2, CASE WHEN p > 1 THEN '' END) OVER q AS g FROM (SELECT doc_id, held, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) y WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
c1 AS (SELECT x, count(*) AS n1 FROM t WHERE NOT held GROUP BY x),
c2 AS (SELECT h, x, count(*) AS n2 FROM t WHERE NOT held GROUP BY h, x),
c3 AS (SELECT g, h, x, count(*) AS n3 FROM t WHERE NOT held AND g IS NOT NULL GROUP BY g, h, x),
f AS (SELECT sum(n1) AS n, count(*) AS v, (SELECT count(*) FROM d WHERE NOT held) AS docs FROM c1),
p AS (SELECT t.doc_id, t.held, coalesce(c1.n1, 0) AS n1, (coalesce(c1.n1, 0) + 0.5::DOUBLE) / (f.n + 0.5::DOUBLE * (f.v + 1)) AS root, coalesce(c2.n2, 0) AS n2, CASE WHEN t.h = '' THEN f.docs ELSE coalesce(o.n1, 0) END AS of1, coalesce(c3.n3, 0) AS n3, coalesce(o2.n2, 0) AS of2, t.g, f.n
 FROM t CROSS JOIN f LEFT JOIN c1 ON c1.x = t.x LEFT JOIN c1 o ON o.x = t.h LEFT JOIN c2 ON c2.h = t.h AND c2.x = t.x LEFT JOIN c2 o2 ON o2.h = t.g AND o2.x = t.h LEFT JOIN c3 ON c3.g = t.g AND c3.h = t.h AND c3.x = t.x),
s AS (SELECT *, (n2 + {_K1}::DOUBLE * root) / (of1 + {_K1}::DOUBLE) AS p2 FROM p)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, CAST(sum(CAST(n1 > 0 AS BIGINT)) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10(root)), 6) AS base_score,
 round(sum(log10(CASE WHEN g IS NULL THEN p2 ELSE (n3 + {_K2}::DOUBLE * p2) / (of2 + {_K2}::DOUBLE) END)), 6) AS score FROM s GROUP BY doc_id, held""",
    "op10_near_dups": f"""
WITH RECURSIVE dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM dw WHERE len(w) > 0) x),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * m >= 75 * (ca.n + cb.n - m)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN c USING (doc_id)""",
    "op11_prefix_trie": f"""
WITH o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT DISTINCT conv_id, {_CRC_CONV} % 4 AS h FROM o),
x AS (SELECT c.conv_id, 0 AS own, i, r, t FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i <= h UNION ALL SELECT conv_id, 1, i, r, t FROM o JOIN c USING (conv_id) WHERE i > h),
s AS MATERIALIZED (SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS k, w FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, md5(octet_length(encode(r)) || ' ' || r || t) AS k, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w FROM x) y
 UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS m, count(*) AS n, any_value(w) AS w FROM s GROUP BY d, k),
e AS (SELECT d, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS z FROM s) q WHERE d = z GROUP BY d, k),
up AS (SELECT n.d, n.k, p.m AS pm FROM n JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1 : 32 * (n.d - 1)]),
kids AS (SELECT d - 1 AS d, k[1 : 32 * (d - 1)] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
pairs AS (SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.d >= a.d),
sub AS (SELECT p.d, p.k, sum(CAST(kids.k IS NULL AS BIGINT)) AS leaves, sum((n.n - 1) * n.w) AS saved FROM pairs p JOIN n ON n.d = p.bd AND n.k = p.bk LEFT JOIN kids ON kids.d = p.bd AND kids.k = p.bk GROUP BY p.d, p.k)
SELECT m AS conv_id, n.d AS depth, pm AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
 FROM n LEFT JOIN up USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN e USING (d, k) JOIN sub USING (d, k)""",
    "op12_vector_dups": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = vec_id""",
}
