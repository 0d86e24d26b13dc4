"""Vectors of a table as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector is there, not empty, and all of its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, bad)


def integers(column: pa.Array, scale: float, dims: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``dims`` finite components, and these times ``scale``, rounded down, as float64."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = (column if len(rows) == len(column) else column.take(pa.array(rows))).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(x).all(axis=1)
    rows, x = (rows, x) if good.all() else (rows[good], x[good])
    x = np.floor(x * scale)
    if x.size and np.abs(x).max() >= limit:
        raise ValueError(f"components times {scale} must be below {limit}")
    return rows, x
