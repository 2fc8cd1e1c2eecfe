"""Vectors of a table as integer components: rows with null or non-finite entries left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, offsets): the places of the rows whose vector is not null and has only
    finite entries; all entries as doubles; where each row of ``column`` begins in them."""
    n = len(column)
    offsets = np.asarray(column.offsets.to_numpy(), np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN here
    offsets = offsets - offsets[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[offsets[1:]] == bad[offsets[:-1]]
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(good) if n else np.zeros(0, np.int64), flat, offsets


def packed(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The ``rows`` of 64-bit ``values`` as binary, eight bytes a component."""
    data = np.ascontiguousarray(values, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets * 8, np.int64)), pa.py_buffer(data)]).take(
            pa.array(rows)).cast(pa.binary())


def matrix(column: pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    """Packed vectors as rows of a matrix; components that a shorter one lacks are 0."""
    cells = column.to_pylist()
    out = np.zeros((len(cells), width), kind)
    for i, cell in enumerate(cells):
        own = np.frombuffer(cell, kind)
        out[i, :len(own)] = own
    return out
