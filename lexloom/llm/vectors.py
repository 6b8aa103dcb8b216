"""Vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, and not zero; of any length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length among the rows: the length, the rows that have it, and these as a matrix in double precision."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, matrix(column if len(rows) == len(column) else column.take(pa.array(rows)), d)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of length d in double precision; the column has neither nulls nor other lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), d)


def scale(x: np.ndarray) -> np.ndarray:
    """Rows divided by their greatest component, then by their norms: no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def kind(column_type) -> str:
    return "<f4" if column_type.elementType.typeName() == "float" else "<f8"
