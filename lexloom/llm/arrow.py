"""Reading UTF-8 columns of Arrow batches as numpy buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, and each row's start and end in them (null: an empty range)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    marks = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    starts, ends = marks[:-1], marks[1:]
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return raw, starts, ends
