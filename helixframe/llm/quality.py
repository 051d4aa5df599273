"""Quality classifier by positive-unlabelled learning.

A small network is fitted by the non-negative unbiased risk
pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]) from trusted positives and
unlabelled texts. The class prior pi is estimated by the best bin: a first classifier
tells positives from unlabelled texts, and the share of unlabelled texts in its upper
range, over that of held-back positives, is least at about pi.

The model sees a bounded sample (``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, chosen by
a hash of the id); every row is scored from its whole text. Inputs of a score are byte
and word figures of the text alone.

Null and empty texts get the score of an all-zero text; rows with a null id are scored
but never learnt from; of rows that repeat an id the one whose text has the least hash is
learnt from and all are scored; several labels of one id count as positive only if all are
1. Without positives or without unlabelled rows to learn from every score is the prior
(0.5 if there are no positives at all). An empty table gives no rows; other columns may have
any names, a column named like the score is replaced. A very long text is held whole in one
task, with about 50 bytes for each of its bytes.
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

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
HIDDEN = 24

# byte classes of the pair counts: 0 other, letters, digits, blanks, marks, non-ASCII
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"'\"-;:()", b"#$%&*@^~", b"<>[]{}|\\/=+_`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)))):
    _CLASS[list(_members)] = _k + 1
_N_CLASS = 16
_BYTE = np.minimum(np.arange(256), 127).astype(np.int64)
N_FEATURES = _N_CLASS * _N_CLASS + 128 + 9


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of figures for each text, from all its bytes."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((rows, N_FEATURES), np.float32)
    if not len(buf):
        return out
    row = np.repeat(np.arange(rows), size)
    c = _CLASS[buf]
    pair = c[:-1] * _N_CLASS + c[1:]
    same = row[:-1] == row[1:]
    n2 = _N_CLASS * _N_CLASS
    pairs = np.bincount((row[:-1] * n2 + pair)[same], minlength=rows * n2).reshape(rows, n2)
    each = np.bincount(row * 128 + _BYTE[buf], minlength=rows * 128).reshape(rows, 128)
    length = np.maximum(size, 1)[:, None]
    out[:, :n2] = np.sqrt(pairs / length)
    out[:, n2 : n2 + 128] = np.sqrt(each / length)

    def distinct(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All, distinct, and directly repeated items of each row."""
        h = T.span_hash(buf, starts, ends) ^ T.mix(owner.astype(np.uint64))
        _, first = np.unique(h, return_index=True)
        again = owner[1:][h[1:] == h[:-1]]
        return tuple(np.bincount(x, minlength=rows) for x in (owner, owner[first], again))

    starts, ends, owner = T.words(buf, offsets, T.NOT_BLANK)
    n_words, d_words, again = distinct(starts, ends, owner)
    n_lines, d_lines, _ = distinct(*T.words(buf, offsets, _IN_LINE))
    w, lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    figures = [np.log1p(size) / 10, np.log1p(n_words) / 10, size / w / 20, d_words / w, d_lines / lines, np.log1p(n_lines) / 5, np.log1p(size / lines) / 10, np.log1p(n_lines - d_lines) / 5, np.sqrt(again / w)]
    out[:, n2 + 128 :] = np.minimum(np.stack(figures, axis=1), 5)
    return out


_IN_LINE = ~T.class_table(b"\n\r")


@dataclass
class Network:
    """Scores are the logistic of one hidden layer of rectified units over scaled inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """The non-negative risk of logits, and the slopes that a step follows.

    With the logistic loss l(g) = log(1 + exp(-g)): pi E_P[l(g)] plus the estimated risk of
    negatives, E_U[l(-g)] - pi E_P[l(-g)], or 0 if that is below zero. A step then undoes
    what made it fall: it goes up the estimate alone.
    """
    n_p, n_u = len(positive), len(unlabelled)
    s_p, s_u = _sigmoid(positive), _sigmoid(unlabelled)  # slopes: l(g) has s - 1, l(-g) has s
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    value = prior * float(np.logaddexp(0, -positive).mean()) + max(0.0, float(negative))
    if negative >= 0:
        return value, (prior * ((s_p - 1) - s_p) / n_p, s_u / n_u)
    return value, (prior * s_p / n_p, -s_u / n_u)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, seed: int) -> Network:
    """Adam on the non-negative risk; with no prior, on plain positive against unlabelled risk."""
    rng = np.random.default_rng(seed)
    n, rows = positive.shape[1], len(positive) + len(unlabelled)
    mean = sum(x.sum(axis=0, dtype=np.float64) for x in (positive, unlabelled)) / rows
    scale = np.sqrt(np.maximum(sum(_squares(x, mean) for x in (positive, unlabelled)) / rows, 0)) + 0.02
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    params = [rng.normal(0, (1 / n) ** 0.5, (n, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, steps + 1):
        x = np.concatenate([positive[rng.integers(0, len(positive), 256)], unlabelled[rng.integers(0, len(unlabelled), 512)]])
        x = (x.astype(np.float32) - mean) / scale
        h = np.maximum(x @ params[0] + params[1], 0)
        g = h @ params[2] + params[3][0]
        if prior is None:
            s = _sigmoid(g)
            d = np.concatenate([(s[:256] - 1) / 256, s[256:] / 512])
        else:
            d = np.concatenate(risk(g[:256], g[256:], prior)[1])
        back = np.outer(d, params[2]) * (h > 0)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d, np.array([d.sum()])]
        for k, gr in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * gr
            second[k] = 0.999 * second[k] + 0.001 * gr * gr
            params[k] = (params[k] - 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior or 0.5)


def _squares(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sums of squared differences from the mean, a part of the rows at a time."""
    return sum((((x[k : k + 1024].astype(np.float64) - mean) ** 2).sum(axis=0) for k in range(0, len(x), 1024)), np.zeros(x.shape[1]))


def estimate_prior(score_positive: np.ndarray, score_unlabelled: np.ndarray) -> float:
    """Best bin: the least ratio, over cuts, of the unlabelled to the positive share above the cut."""
    cuts = np.quantile(score_positive, np.linspace(0.02, 0.95, 60))
    n_p, n_u = len(score_positive), len(score_unlabelled)
    q_p = np.array([(score_positive >= c).mean() for c in cuts])
    q_u = np.array([(score_unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (n_p**-0.5 + n_u**-0.5)
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 1500, seed: int = 7) -> Network:
    """Network fitted by the non-negative risk; the prior is estimated where not given."""
    if not len(positive) or not len(unlabelled):
        n = N_FEATURES
        p = min(max(prior or (0.98 if len(positive) else 0.5), 1e-6), 1 - 1e-6)
        return Network(np.zeros(n, np.float32), np.ones(n, np.float32), np.zeros((n, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), float(np.log(p / (1 - p))), p)
    if prior is None:
        half_p, half_u = max(1, len(positive) * 3 // 4), max(1, len(unlabelled) * 3 // 4)
        net = _fit(positive[:half_p], unlabelled[:half_u], None, steps // 3, seed)
        rest_p, rest_u = positive[half_p:], unlabelled[half_u:]
        prior = estimate_prior(net.logit(rest_p if len(rest_p) else positive), net.logit(rest_u if len(rest_u) else unlabelled))
    return _fit(positive, unlabelled, prior, steps, seed)


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id falls in none."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _featured(rows: DataFrame) -> DataFrame:
    """(y, x): marks and half-precision figures of all rows of an Arrow batch, one row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column(1))
            x = [features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float16).tobytes() for i, j in T.slices(offsets)]
            y = b.column(0).to_numpy().astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.binary()), pa.array([b"".join(x)], pa.binary())], names=["y", "x"])

    return rows.select("y", "t").mapInArrow(run, "y binary, x binary")


def train(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None) -> Network:
    """Fit on rows of ``documents`` for which ``learn`` (a condition on the id) holds."""
    bounded_batches(documents)
    known = labels.groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("q"))
    ids = documents.where(learn).select(F.col(id_col).alias("k")).where("k is not null").distinct().join(known, "k", "left")
    order = F.xxhash64(F.col("k"), F.lit("quality"))
    trusted = ids.where("q = 1").orderBy(order, "k").limit(MAX_POSITIVE).select("k", F.lit(1).alias("y"))
    rest = ids.where("q is null").orderBy(order, "k").limit(MAX_UNLABELLED).select("k", F.lit(0).alias("y"))
    sample = F.broadcast(trusted.union(rest))  # MAX_POSITIVE + MAX_UNLABELLED ids at most
    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(sample, "k")
    one = rows.groupBy("k").agg(F.min_by(F.struct("y", "t"), F.struct(F.xxhash64("t"), "t")).alias("r"))
    got = _featured(one.select("r.y", "r.t")).collect()
    y = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r["y"], np.int8) for r in got)])
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float16), *(np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES) for r in got)])
    del got
    # one order, however the rows arrived
    key = x.view(np.uint16).astype(np.uint64) @ T.mix(np.arange(1, N_FEATURES + 1, dtype=np.uint64))
    order = np.lexsort((key, y))
    np.random.default_rng(3).shuffle(order)
    x, y = x[order], y[order]
    return fit(x[y == 1], x[y == 0], prior)


def score(documents: DataFrame, network: Network, text_col: str = "text", to: str = "score") -> DataFrame:
    """``documents`` with one more column, the score of each row's whole text.

    A column of that name is replaced.
    """
    rows = bounded_batches(documents).drop(to)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = T.flat(b.column(at))
            out = [network.score(features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in T.slices(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names, to])

    return rows.mapInArrow(run, with_columns(rows, f"`{to}` double"))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) per row, learnt outside the held-out fold."""
    held = in_fold(F.col(id_col), folds, fold)
    network = train(documents, labels, ~held, id_col, text_col)
    scored = score(documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), network, "text")
    return scored.select(F.col(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without the rows whose score is below 0.5; all columns stay."""
    network = train(documents, labels, ~in_fold(F.col(id_col), folds, fold), id_col, text_col)
    return score(documents, network, text_col, "__quality").where("__quality >= 0.5").select(*documents.columns)
