"""Shared helpers: bounded text slices inside tasks, column access, hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: UTF-8 bytes of text that a task turns into numpy arrays at once. One longer
#: text is taken alone, whole.
SLICE_BYTES = 2_000_000

ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (wraps on overflow)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) over the ``text`` column; nulls become empty texts."""
    texts = batch.column(batch.schema.get_field_index("text"))
    lengths = np.maximum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False), 1)
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and size + n > limit:
            yield first, ["" if t is None else t for t in texts.slice(first, i - first).to_pylist()]
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, ["" if t is None else t for t in texts.slice(first).to_pylist()]


def segment_index(lengths: np.ndarray) -> np.ndarray:
    """Segment number of every element, for segments of the given lengths."""
    return np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)


def within(lengths: np.ndarray) -> np.ndarray:
    """Position inside its own segment of every element."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def third(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def held_out(id_col: str = "doc_id") -> Column:
    """True where the remainder is 1; a null id is not held out."""
    return F.coalesce(third(id_col) == 1, F.lit(False))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
