"""Language-model scores by a weighted backoff automaton over words.

The model has words, pairs and triples with Dirichlet smoothing:
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), p(w|v) = (c(vw) + K1 p(w)) / (c(v) + K1) and
p(w|uv) = (c(uvw) + K2 p(w|v)) / (c(uv) + K2). As an automaton:

* states are the root, every training word v and every training pair uv;
* a state has an arc for each word that followed it in training, with the logarithm of the
  smoothed probability; the arc for w leads to the state of the last two words, here vw;
  the root has an arc for each word, known or not;
* every state but the root has a failure arc to the state without its oldest word, whose
  weight is the logarithm of K / (c + K).

A text is read from left to right. The traversal carries the state: it takes the next
word's arc if there is one, else failure arcs until there is one, and adds up the weights.
Weights sum to one in each state, over all words and the unknown one. All texts of a slice
are read side by side; a long text is cut into pieces, and each piece starts in the state
that the two words before it lead to, which is the state of the uncut traversal.

No count is capped and nothing of the vocabulary is broadcast. Documents form blocks of
about ``BLOCK_BYTES`` (ranges of ids where ids are numbers, so that neighbours in a file
share a block). Each Arrow task counts the n-grams of a block and sends sorted hashes
with counts to shards of the hash space; a shard adds the counts of all blocks and answers
each block with the totals in the order of the block's own sorted hashes, so no hash is
sent back; the block then builds the part of the automaton that its texts can reach. A hot
word is one entry for each task and block.

n-grams are 64-bit hashes. Null and empty texts are one end mark; rows with a null id are
learnt from and form a block of their own kind; repeated rows count each time; other
columns, whatever their names, are ignored; an empty table gives no rows. A very long text
is held whole in one task, with about 100 bytes for each of its tokens.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text as T
from ._spark import bounded_batches, dealt, stored
from .quality import in_fold

#: Text of a block; its words and counts are in memory together.
BLOCK_BYTES = 8 << 20
#: Tokens that a counting task gathers before it sends counts.
FLUSH_TOKENS = 2_500_000
#: Tokens of the corpus for each shard of the hash space of one order.
SHARD_TOKENS = 3_000_000
#: Most ranges of ids; more blocks than that split ranges by a hash.
RANGES = 1_000
#: K1 and K2: how many observations the lower order is worth in a state.
SMOOTHING = (32.0, 8.0)
#: Words of a text that one lane of the traversal reads.
LANE = 512

START, END = np.uint64(0x5354415254A5A5A5), np.uint64(0x454E44A5A5A5A5A5)
ORDERS = (1, 2, 3)


def tokens(buf: np.ndarray, offsets: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end mark after each text, and the bounds of each text's tokens."""
    rows = len(offsets) - 1
    low = T.lower_ascii(buf)
    starts, ends, row = T.words(low, offsets, T.NOT_BLANK)
    out = np.full(len(starts) + rows, END, np.uint64)
    out[np.arange(len(starts)) + row] = T.span_hash(low, starts, ends, key)
    return out, T.row_bounds(row, rows) + np.arange(rows + 1)


def ngrams(token: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts that begin with START, and the token each ends with."""
    if order == 1:
        return token, np.arange(len(token))
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = START
    if order == 2:
        return T.mix(before * np.uint64(0x9FB21C651E98DF25) + token), np.arange(len(token))
    inner = np.ones(len(token), bool)
    inner[bounds[:-1]] = False  # a text's first token has START alone before it
    at = np.flatnonzero(inner)
    second = before[at - 1]
    return T.mix(T.mix(second * np.uint64(0x9FB21C651E98DF25) + before[at]) * np.uint64(0xD6E8FEB86659FD93) + token[at]), at


def _pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes and counts by byte planes: planes of sorted hashes and of small counts compress."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T).tobytes() + _planes(counts)


def _planes(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    return _unplaned(blob, n).view(np.uint64), _unplaned(blob, n, 8 * n)


def _counted(h: np.ndarray, train: np.ndarray, order: int, block: int, bits: int, out: list[list]) -> None:
    """Append (order and shard, block, blob) rows with the training counts of a block's hashes."""
    distinct, inverse = np.unique(h, return_inverse=True)
    count = np.bincount(inverse[train], minlength=len(distinct))
    edges = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        for x, v in zip(out, (order << 32 | int(s), block, _pack(distinct[part], count[part])), strict=True):
            x.append(v)


@dataclass
class Automaton:
    """The part of the model that a block's texts can reach.

    States are numbered: 0 the root, then words, then pairs. ``arc`` holds state * words +
    word of every arc but the root's, ascending; weights are natural logarithms.
    """

    words: int
    root: np.ndarray  # weight of the root's arc for each word
    root_to: np.ndarray
    arc: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    failure: np.ndarray  # state that each state falls back to
    fall: np.ndarray  # weight of that
    start: int

    def read(self, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each text of word numbers, by one traversal of each."""
        size = np.diff(bounds)
        pieces = np.maximum(-(-size // LANE), 1)
        row = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, end = bounds[:-1][row] + k * LANE, np.minimum(bounds[:-1][row] + (k + 1) * LANE, bounds[1:][row])
        order = np.argsort(at - end, kind="stable")  # longest first: the lanes still read are a prefix
        at, end, row, k = at[order], end[order], row[order], k[order]
        state = np.where(k == 0, self.start, 0)
        total = np.zeros(len(row))
        # two words before a piece lead to its state; their weights belong to the piece before
        inner = np.flatnonzero(k > 0)
        for back in (2, 1):
            if len(inner):
                state[inner], _ = self.step(state[inner], word[at[inner] - back])
        n = end - at
        active = len(row)
        for t in range(int(n.max(initial=0))):
            while active and n[active - 1] <= t:
                active -= 1
            state[:active], w = self.step(state[:active], word[at[:active] + t])
            total[:active] += w
        return np.bincount(row, weights=total, minlength=len(size))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and the weights of the arcs taken, failure arcs included."""
        state = state.copy()
        to, total = self.root_to[word], np.zeros(len(state))
        open_ = np.flatnonzero(state > 0)
        while len(open_) and len(self.arc):
            key = state[open_] * self.words + word[open_]
            found = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[found] == key
            taken = open_[hit]
            to[taken] = self.to[found[hit]]
            total[taken] += self.weight[found[hit]]
            state[taken] = -1
            open_ = open_[~hit]
            total[open_] += self.fall[state[open_]]
            state[open_] = self.failure[state[open_]]
            open_ = open_[state[open_] > 0]
        if len(open_):  # no state has an arc
            while len(open_):
                total[open_] += self.fall[state[open_]]
                state[open_] = self.failure[state[open_]]
                open_ = open_[state[open_] > 0]
        at_root = np.flatnonzero(state == 0)
        total[at_root] += self.root[word[at_root]]
        return to, total


def build(token: np.ndarray, bounds: np.ndarray, totals: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, v: int, documents: int, smoothing: tuple[float, float] = SMOOTHING) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The automaton of a block's n-grams, the word number of each token and the counts of words.

    totals: training counts of the block's distinct words, pairs and triples, by ascending hash.
    """
    numbered, example = [], []
    for order in ORDERS:
        h, at = ngrams(token, bounds, order)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(distinct) != len(totals[order - 1]):
            raise ValueError("the answers of the shards do not fit the block's n-grams")
        if order == 3:
            example.append(at[first])
        else:
            example.append(first)
            numbered.append(inverse.astype(np.int64))
    words, pairs, triples = totals
    word, pair = numbered
    n_words = len(words)
    root = (words + 0.5) / (n + 0.5 * (v + 1))
    begin = np.zeros(len(token), bool)
    begin[bounds[:-1]] = True
    # numbers of states: word states follow the root, START's is the one after them, then pairs
    start = 1 + n_words
    pair_state = np.where(pairs > 0, start + 1 + np.arange(len(pairs)), 0)
    word_state = np.where(words > 0, 1 + np.arange(n_words), 0)
    at = example[1]
    second = word[at]  # last word of each pair
    oldest = np.where(begin[at], start, word_state[word[at - 1]])  # state of its first word
    seen = np.concatenate([[0], words, [documents]]).astype(np.float64)  # of root and word states
    k1, k2 = smoothing
    p_pair = (pairs + k1 * root[second]) / (seen[oldest] + k1)
    real = pairs > 0
    arcs = [(oldest[real], second[real], p_pair[real], pair_state[real])]
    at = example[2]
    context, last = pair[at - 1], pair[at]
    real = triples > 0
    # p(w|v) of a triple is the smoothed probability of its last two words
    p_triple = (triples + k2 * p_pair[last]) / (pairs[context] + k2)
    arcs.append((pair_state[context][real], word[at][real], p_triple[real], pair_state[last][real]))
    state, by, p, to = (np.concatenate(x) for x in zip(*arcs, strict=True))
    arc = state * n_words + by
    order = np.argsort(arc, kind="stable")
    known = np.where(words > 0)[0]
    failure = np.zeros(start + 1 + len(pairs), np.int64)
    fall = np.zeros(len(failure))
    fall[1 + known] = np.log(k1 / (words[known] + k1))
    fall[start] = np.log(k1 / (documents + k1))
    held = np.flatnonzero(pairs > 0)
    failure[pair_state[held]] = word_state[second[held]]
    fall[pair_state[held]] = np.log(k2 / (pairs[held] + k2))
    made = Automaton(max(n_words, 1), np.log(root), word_state, arc[order], np.log(p[order]), to[order], failure, fall, start)
    return made, word, words


def _blocks(documents: DataFrame, id_col: str, total: int) -> tuple[Column, int]:
    """A block number for each row, and how many there are."""
    n = 1 + total // BLOCK_BYTES
    key = F.xxhash64(F.col(id_col), F.lit(9))
    if not isinstance(documents.schema[id_col].dataType, S.IntegralType):
        return F.pmod(key, F.lit(n)).cast("int"), n
    ranges = min(n, RANGES)
    inner = -(-n // ranges)
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = documents.agg(F.percentile_approx(F.col(id_col), shares, 100 * ranges).alias("c")).first()["c"] or []
    where = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.coalesce(F.col(id_col).cast("long"), F.lit(0)))) if cuts else F.lit(0)
    return (where * inner + F.pmod(key, F.lit(inner))).cast("int"), ranges * inner


def score(documents: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    The model learns from the rows for which ``held_out`` (a condition on the id) is not true.
    """
    bounded_batches(documents)
    key = secrets.token_bytes(16)  # for the hashes of words: nobody can write words that collide
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    total = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    block, n_blocks = _blocks(documents, id_col, int(total))
    bits = max(2, int(np.ceil(np.log2(1 + total / 6 / SHARD_TOKENS))))
    rows = documents.select(F.col(id_col).alias("k"), held.alias("held"), block.alias("block"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[], [], [], []]  # tokens; of texts: size, block, train
        size = 0

        def flush() -> pa.RecordBatch:
            token, n, of, train = (np.concatenate(x) for x in kept)
            begin = np.cumsum(n) - n
            out: list[list] = [[], [], []]
            for b in np.unique(of):
                own = np.flatnonzero(of == b)
                at = np.repeat(begin[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
                learnt = np.repeat(train[own], n[own])
                for order in ORDERS:
                    h, last = ngrams(token[at], np.append(0, np.cumsum(n[own])), order)
                    _counted(h, learnt[last], order, int(b), bits, out)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["shard", "block", "blob"])

        for b in batches:
            held_, block_ = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buf, offsets = T.flat(b.column(2))
            for i, j in T.slices(offsets):
                token, bounds = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key)
                for x, v in zip(kept, (token, np.diff(bounds), block_[i:j], ~held_[i:j].astype(bool)), strict=True):
                    x.append(v)
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    kept, size = [[], [], [], []], 0
        if size:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_unpack(x) for x in table.column("blob").to_pylist()]
        of = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts])
        h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        distinct, inverse = np.unique(h, return_inverse=True)
        sums = np.bincount(inverse, weights=c, minlength=len(distinct)).astype(np.int64)
        del c
        blocks, figures, answers = [], [], []
        if shard >> 32 == 1:
            blocks.append(-1)
            figures.append([int(sums.sum()), int((sums > 0).sum()), int(sums[distinct == END].sum())])
            answers.append(None)
        order = np.argsort(of, kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate(([True], np.diff(of[order]) != 0))), len(of))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            blocks.append(int(of[order[i]]))
            figures.append(None)
            answers.append(_planes(sums[np.unique(inverse[order[i:j]])]))  # ascending hashes, each once
        return pa.table({"block": pa.array(blocks, pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int64()), "counts": pa.array(answers, pa.binary()), "figures": pa.array(figures, pa.list_(pa.int64()))})

    sent = rows.select("held", "block", "t").mapInArrow(count, "shard long, block int, blob binary")
    totals = stored(dealt(sent, "shard", len(ORDERS) << bits).groupBy("shard").applyInArrow(add, "block int, shard long, counts binary, figures array<long>"))
    n, v, ends = totals.where("block = -1").agg(*[F.coalesce(F.sum(F.col("figures")[k]), F.lit(0)) for k in range(3)]).first()

    def finish(docs: pa.Table, model: pa.Table) -> pa.Table:
        answers = sorted(zip(model.column("shard").to_pylist(), model.column("counts").to_pylist(), strict=True))
        counts = tuple(np.concatenate([np.zeros(0, np.int64), *(_unplaned(x, len(x) // 8) for s, x in answers if s >> 32 == order)]) for order in ORDERS)
        buf, offsets = T.flat(docs.column("t"))
        token, bounds, at = [], [np.zeros(1, np.int64)], 0
        for i, j in T.slices(offsets):
            h, own = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key)
            token.append(h)
            bounds.append(own[1:] + at)
            at += len(h)
        edges = np.concatenate(bounds)
        columns = {"n_tokens": np.diff(edges), "n_known": np.zeros(len(edges) - 1, np.int64), "base_score": np.zeros(len(edges) - 1), "score": np.zeros(len(edges) - 1)}
        if at:
            automaton, word, seen = build(np.concatenate(token), edges, counts, int(n), int(v), int(ends))
            row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            columns["n_known"] = np.bincount(row[seen[word] > 0], minlength=len(edges) - 1)
            columns["base_score"] = np.bincount(row, weights=automaton.root[word] / np.log(10), minlength=len(edges) - 1)
            columns["score"] = automaton.read(word, edges) / np.log(10)
        return pa.table({"k": docs.column("k"), "held": docs.column("held"), **columns})

    schema = S.StructType([*rows.schema.fields[:2], *S.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")])
    sides = [dealt(x, "block", n_blocks).groupBy("block") for x in (rows, totals.where("block >= 0"))]
    done = sides[0].cogroup(sides[1]).applyInArrow(finish, schema)
    return done.select(F.col("k").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(documents: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() with the model learnt outside the held-out fold of ids."""
    return score(documents, in_fold(F.col(id_col), folds, fold), id_col, text_col)


__all__ = ["Automaton", "build", "ngrams", "score", "score_held_out", "tokens"]
