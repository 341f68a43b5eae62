"""Arrow columns and numpy matrices into each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def long_lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, of ``width`` numbers each, as rows."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
    if len(out) != len(column):
        raise ValueError(f"vectors must have {width} numbers")
    return out
