"""Vectors out of Arrow batches, as one double-precision matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x dim, and which rows are usable: not null, of that length, not zero, no null or non-finite component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out = np.zeros((n, dim))
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    fits = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy(zero_copy_only=False)[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out[fits] = values[starts[fits][:, None] + np.arange(dim)] if fits.any() else 0
    good = fits & np.isfinite(out).all(1)
    out[~good] = 0
    good &= (out != 0).any(1)
    return out, good


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one (zero rows stay), safe from overflow."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    y = x / np.where(top > 0, top, 1)
    norm = np.sqrt((y * y).sum(1, keepdims=True))
    return y / np.where(norm > 0, norm, 1)
