"""Helpers shared by the text operators: column picking, staging, Arrow text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written as staged  # noqa: F401  (text operators and the pipeline take it from here)

#: Whitespace of the word contracts: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Text bytes that a vectorised step holds at once; larger single texts form a block of their own.
BLOCK_BYTES = 1 << 20


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and text (null: empty) under fixed names, whatever other columns the table has."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def bucket_of(col: Column | str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n: the split of the learning contracts (null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")), F.lit(0)) % n


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about `limit` text bytes, so that working memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column back to back, and len+1 offsets into them; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)), at - at[0]


def sums_between(values: np.ndarray, at: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i; 0 for empty spans."""
    out = np.zeros(len(at) - 1, dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[full], dtype=dtype)
    return out


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z only, as a Column."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
