"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward network read a text, every byte position gets a probability for
each language, and a document's probability is the mean over its positions that belong to
letters. Whole texts are read, in windows of ``READ`` bytes side by side; each window also
reads ``CONTEXT`` bytes before and after it, whose positions it does not label, so that its
states know what stands around it. Gates and candidates use x / (1 + |x|), which costs an
eighth of the hyperbolic tangent here. A step is a few matrix operations over thousands of
lanes.

Training is backpropagation through time in numpy on a bounded number of labelled pieces:
``SAMPLE_PER_LANGUAGE`` rows of each language, the least by a hash of the id, and of all
pieces of ``WINDOW`` bytes of their whole texts the ``PIECES_PER_LANGUAGE`` least by a hash.
Every language is found in one pass, by the least hashes of each task and then of all.

``und`` (score 0) is returned for null texts and texts without a letter, and for all
rows if there is nothing to learn from. Rows with a null id are labelled, not learnt
from; rows that repeat an id are all labelled and all learnt from, equal pieces once; equal
probabilities go to the first language by name; an empty table gives no rows; other columns
may have any names. Very long texts are cut into slices whose sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded_batches, with_columns
from .quality import in_fold

WINDOW = 64
READ, CONTEXT = 256, 16
HIDDEN = 8
SAMPLE_PER_LANGUAGE = 800
PIECES_PER_LANGUAGE = 6_400
#: Buckets in which the least hashes of all tasks meet before they meet in one.
BUCKETS = 64
#: Windows that run side by side.
LANES = 1024
UNDETERMINED = "und"

#: ASCII letters and all bytes of non-ASCII characters.
_LETTER = T.class_table(bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)]))


@dataclass
class BiGRU:
    """table[d]: gate inputs (update, reset, candidate) of each byte; u, c: recurrent weights and candidate bias.

    d is 0 for left to right, 1 for right to left; w, b make a position's logits.
    """

    languages: list[str]
    table: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    w: np.ndarray
    b: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.u, *self.c, self.w, self.b]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> BiGRU:
    rng = np.random.default_rng(seed)
    f = np.float32
    return BiGRU(
        languages,
        [rng.normal(0, 0.3, (3 * hidden, 256)).astype(f) for _ in range(2)],
        [rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(f) for _ in range(2)],
        [np.zeros((hidden, 1), f) for _ in range(2)],
        rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(f),
        np.zeros((len(languages), 1), f),
    )


def _run(table: np.ndarray, u: np.ndarray, c: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, H, lanes) of one direction over bytes x (T, lanes); with keep, what the way back needs."""
    steps, lanes = x.shape
    n = len(c)
    h = np.zeros((n, lanes), np.float32)
    out = np.empty((steps, n, lanes), np.float32)
    a, size = np.empty((3 * n, lanes), np.float32), np.empty((2 * n, lanes), np.float32)
    kept = []
    for t in range(steps):
        np.take(table, x[t], axis=1, out=a, mode="clip")
        v = u @ h
        s = a[: 2 * n]
        s += v[: 2 * n]
        np.abs(s, out=size)
        size += 1
        s /= size
        gates = s * np.float32(0.5)
        gates += np.float32(0.5)
        z, r = gates[:n], gates[n:]
        inner = v[2 * n :]
        inner += c
        m = r * inner
        m += a[2 * n :]
        np.abs(m, out=size[:n])
        size[:n] += 1
        m /= size[:n]
        if keep:
            kept.append((h, z, r, inner, m))
        h = h - m
        h *= z
        h += m
        out[t] = h
    return out, kept


def position_probabilities(model: BiGRU, x: np.ndarray) -> np.ndarray:
    """(languages, T, lanes): the probability of each language at each position."""
    steps, lanes = x.shape
    n = model.c[0].shape[0]
    fore, _ = _run(model.table[0], model.u[0], model.c[0], x, False)
    back, _ = _run(model.table[1], model.u[1], model.c[1], x[::-1], False)
    logits = np.matmul(model.w[:, :n], fore) + np.matmul(model.w[:, n:], back[::-1])  # (T, C, lanes)
    logits += model.b
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.transpose(1, 0, 2)


def _gradients(model: BiGRU, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients through time."""
    steps, lanes = x.shape
    n = model.c[0].shape[0]
    runs = [_run(model.table[d], model.u[d], model.c[d], x if d == 0 else x[::-1], True) for d in (0, 1)]
    states = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=1)  # (T, 2H, lanes)
    logits = np.matmul(model.w, states) + model.b
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, y, np.arange(lanes)], 1e-9)).mean())
    p[:, y, np.arange(lanes)] -= 1
    p /= steps * lanes
    d_w = np.einsum("tcl,thl->ch", p, states)
    d_b = p.sum(axis=(0, 2))[:, None]
    d_states = np.matmul(model.w.T, p)
    out: list[list[np.ndarray]] = [[], [], []]
    for d in (0, 1):
        kept = runs[d][1]
        source = d_states[:, :n] if d == 0 else d_states[::-1, n:]
        seq = x if d == 0 else x[::-1]
        u = model.u[d]
        d_table, d_u, d_c = np.zeros_like(model.table[d]), np.zeros_like(u), np.zeros_like(model.c[d])
        d_h = np.zeros((n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, inner, m = kept[t]
            d_h = d_h + source[t]
            d_m = d_h * (1 - z) * (1 - np.abs(m)) ** 2
            d_z = d_h * (h - m) * (1 - np.abs(2 * z - 1)) ** 2 / 2
            d_r = d_m * inner * (1 - np.abs(2 * r - 1)) ** 2 / 2
            d_inner = d_m * r
            into = np.concatenate([d_z, d_r, d_m])
            rec = np.concatenate([d_z, d_r, d_inner])
            for k in range(3 * n):
                d_table[k] += np.bincount(seq[t], weights=into[k], minlength=256)
            d_u += rec @ h.T
            d_c += d_inner.sum(axis=1, keepdims=True)
            d_h = d_h * z + u.T @ rec
        for k, g in enumerate((d_table, d_u, d_c)):
            out[k].append(g)
    return loss, [*out[0], *out[1], *out[2], d_w, d_b]


def train_windows(languages: list[str], windows: np.ndarray, y: np.ndarray, steps: int = 260, lanes: int = 192, seed: int = 5) -> BiGRU:
    """Adam over random batches of windows (rows of bytes) with language numbers y."""
    model = new_model(languages, seed=seed)
    rng = np.random.default_rng(seed)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(windows), lanes)
        _, grads = _gradients(model, windows[pick].T, y[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * (1 - 0.9 * t / steps)
        for k, g in enumerate(grads):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def cut_windows(buf: np.ndarray, offsets: np.ndarray, width: int = WINDOW, context: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover each text, with ``context`` bytes more on both sides, the row of each, and
    its number of real bytes; what lies outside the text is spaces."""
    size = np.diff(offsets)
    n = -(-size // width)
    row = np.repeat(np.arange(len(size)), n)
    at = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * width
    real = np.minimum(width, offsets[1:][row] - at)
    place = at[:, None] + np.arange(-context, width + context)
    inside = (place >= offsets[:-1][row][:, None]) & (place < offsets[1:][row][:, None])
    w = buf[np.where(inside, place, 0)] if len(buf) else np.zeros(place.shape, np.uint8)
    w[~inside] = 32
    return w, row, real


def pooled(model: BiGRU, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of position probabilities over letters, (rows, languages), and the numbers of such positions."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, len(model.languages))), np.zeros(rows)
    for i, j in T.slices(offsets):
        at = offsets[i]
        part, off = buf[at : offsets[j]], offsets[i : j + 1] - at
        for begin in range(0, max(1, int(off[-1])), T.SLICE_BYTES) if j - i == 1 else (0,):
            # one text longer than a slice goes in pieces
            piece, edge = (part[begin : begin + T.SLICE_BYTES], np.array([0, min(T.SLICE_BYTES, len(part) - begin)])) if j - i == 1 else (part, off)
            windows, row, _ = cut_windows(piece, edge, READ, CONTEXT)
            for k in range(0, len(windows), LANES):
                x = np.ascontiguousarray(windows[k : k + LANES].T)
                letters = _LETTER[x[CONTEXT : CONTEXT + READ]]
                p = position_probabilities(model, x)[:, CONTEXT : CONTEXT + READ]
                sums = (p * letters).sum(axis=1)
                np.add.at(total, i + row[k : k + LANES], sums.T)
                np.add.at(count, i + row[k : k + LANES], letters.sum(axis=0))
    return total, count


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The n distinct rows (k, l, h) of least (h, k) of each l: of each task, of each bucket, of all."""

    def keep(table: pa.Table) -> pa.Table:
        best = table.group_by(["k", "l", "h"]).aggregate([]).select(["k", "l", "h"]).sort_by([("l", "ascending"), ("h", "ascending"), ("k", "ascending")])
        names = best.column("l").combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
        rank = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
        return best.filter(pa.array(rank < n))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 16 * n:
                held = keep(pa.Table.from_batches(held)).to_batches()
                size = sum(x.num_rows for x in held)
        if held:
            yield from keep(pa.Table.from_batches(held)).to_batches()

    first = rows.mapInArrow(local, rows.schema).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    fewer = first.groupBy("l", "bucket").applyInArrow(lambda t: keep(t.drop_columns(["bucket"])), rows.schema)
    return fewer.groupBy("l").applyInArrow(keep, rows.schema)


def train(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGRU | None:
    """Fit on a bounded sample of the rows for which ``learn`` holds; None without any."""
    rows = bounded_batches(documents).where(learn).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col), F.lit("language")).alias("h"))
    picked = _least(ids, SAMPLE_PER_LANGUAGE)
    texts = rows.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column(1))
            for i, j in T.slices(offsets):
                w, row, _ = cut_windows(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = T.mix(w.view(np.uint64) @ T.mix(np.arange(1, WINDOW // 8 + 1, dtype=np.uint64))).view(np.int64)
                good = _LETTER[w].sum(axis=1) >= 8
                own = b.column(0).take(pa.array(i + row[good]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in w[good]], pa.binary()), own, pa.array(h[good])], names=["k", "l", "h"])

    sample = F.broadcast(picked.select("k", "l"))  # SAMPLE_PER_LANGUAGE ids of each language at most
    pieces = texts.join(sample, ["k", "l"]).select("l", "t").mapInArrow(cut, "k binary, l string, h long")
    got = sorted((r["l"], bytes(r["k"])) for r in _least(pieces, PIECES_PER_LANGUAGE).collect())
    languages = sorted({name for name, _ in got})
    windows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(name) for name, _ in got], np.int64)
    if not len(windows):
        return None
    # equal shares: a frequent language is no better explanation of a text
    rng = np.random.default_rng(11)
    share = max(np.bincount(y, minlength=len(languages)).max(), 1)
    pick = np.concatenate([rng.choice(np.flatnonzero(y == k), share) for k in range(len(languages)) if (y == k).any()])
    return train_windows(languages, windows[pick], y[pick])


def predict(documents: DataFrame, model: BiGRU | None, text_col: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score; columns of those names are replaced."""
    rows = documents.drop("lang_pred", "score")
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    rows = rows.withColumn("__lettered", lettered)
    at = rows.columns.index(text_col)
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, count = pooled(model, *T.flat(b.column(at)))
            good = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & (count > 0)
            p = total / np.maximum(count, 1)[:, None]
            best = np.where(good, p.argmax(axis=1), len(names) - 1) if b.num_rows else np.zeros(0, int)
            s = np.where(good, np.clip(p.max(axis=1), 0, 1), 0.0) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best].tolist(), pa.string()), pa.array(s)], names=[*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, with_columns(rows, "lang_pred string, score double")).drop("__lettered")


def identify(documents: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) per row, learnt outside the held-out fold."""
    held = in_fold(F.col(id_col), folds, fold)
    model = train(documents, ~held, id_col, text_col, lang_col)
    found = predict(documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), model, "text")
    return found.select(F.col(id_col), held.alias("held_out"), "lang_pred", "score")
