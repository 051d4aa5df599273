"""Token counts: batch encoding in an Arrow function that returns lengths only.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: before
white space that follows a character which is surely not white space. Each such
unit then encodes alike wherever it stands, so a batch encodes every distinct
unit once, in calls of about equal bytes, and sums lengths. Units are told apart by
their bytes. A very long text is handed to the tokenizer in such calls; only one without
any safe boundary is encoded at once.

Null and empty texts count 0 tokens; repeated rows and ids are kept; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import bounded_batches, with_columns

#: Distinct units whose lengths a worker remembers, and the longest of them in bytes.
CACHE_UNITS, UNIT_BYTES = 500_000, 64
#: Bytes handed to one call of the tokenizer.
CALL_BYTES = 256 << 10

_WHITE = T.class_table(b" \t\n\v\f\r")


def safe_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets at which a unit starts: each row's start and each safe boundary.

    The byte before a boundary ends either a visible ASCII character or a
    two-byte character; of those from U+00C0 on none is white space.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)
    before[2:] |= (buf[1:-1] >= 0x80) & (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF)
    cut = _WHITE[buf] & before
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


def load_tokenizer(path: str):
    """The tokenizer of a ``.json`` or ``.model`` file as a function from texts to lengths."""
    if path.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]


class UnitCounter:
    """Counts tokens of many texts; ``split`` is False for tokenizers without safe boundaries."""

    def __init__(self, lengths, split: bool = True):
        self.lengths, self.split, self.known = lengths, split, {}

    def encode(self, raw: list[bytes]) -> list[int]:
        out: list[int] = []
        call: list[str] = []
        size = 0
        for x in raw:
            call.append(x.decode("utf-8", "replace"))
            size += len(x)
            if size >= CALL_BYTES:
                out += self.lengths(call)
                call, size = [], 0
        return out + (self.lengths(call) if call else [])

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in T.slices(offsets):
            at = offsets[i]
            part, off = buf[at : offsets[j]], offsets[i : j + 1] - at
            starts = safe_starts(part, off) if self.split else off[:-1][off[:-1] < off[1:]]
            if not len(starts):
                continue
            distinct, inverse = T.spans(part, starts, np.append(starts[1:], len(part)))
            n = list(map(self.known.get, distinct))
            new = [k for k, v in enumerate(n) if v is None]
            if new:
                got = self.encode([distinct[k] for k in new])
                for k, v in zip(new, got, strict=True):
                    n[k] = v
                    if len(distinct[k]) <= UNIT_BYTES:
                        if len(self.known) >= CACHE_UNITS:
                            self.known.clear()
                        self.known[distinct[k]] = v
            row = np.searchsorted(off, starts, "right") - 1
            out[i:j] = np.bincount(row, weights=np.array(n, np.float64)[inverse], minlength=j - i).astype(np.int64)
        return out


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``tokenizer_path`` names a file that every executor has.
    """
    rows = bounded_batches(documents).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnitCounter(load_tokenizer(tokenizer_path), tokenizer_path.endswith("byte_bpe_50k.json"))
        for b in batches:
            buf, offsets = T.flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(counter.count(buf, offsets))], names=["k", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, with_columns(rows.select("k"), "n_bytes long, n_tokens long"))
    return counted.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
