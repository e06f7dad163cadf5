"""Byte-level text normalisation shared by the operators: ASCII lower-casing and the two word classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z to a-z, all else as it is. Words `[^\x20\x09-\x0D]+` are then what bytes.split() gives.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z; every ASCII character but digits and letters to a space. Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(LOWER)

ASCII_UPPER, ASCII_LOWER = _UPPER.decode(), _LOWER.decode()


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df has not, in any case, and that are no two the same."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, so that a worker's memory doesn't follow text length."""
    text = batch.column(column)
    if text.nbytes <= limit or batch.num_rows < 2:
        yield batch
        return
    sizes = np.cumsum(_lengths(text))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def _lengths(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
