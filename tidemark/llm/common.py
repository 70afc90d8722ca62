"""Expressions shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the cheap built-in serves where the text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a whole text, as two longs: equal texts share their results."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``rows`` rows; otherwise
    as it is, so that joins with it shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), then those of start[1], and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows, each of at most ``size`` bytes (or list elements) of
    ``column``, or of one larger row."""
    values = batch.column(column)
    measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    upto, first = np.cumsum(measure(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + size, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last
