"""Numpy helpers for vector columns of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and float64 matrix of the usable vectors, for each dimension that occurs.

    Left out: null vectors, empty ones, and those that are zero or hold null or non-finite components.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    ends = np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        matrix = values[(ends[at] - d)[:, None] + np.arange(d)[None, :]]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            yield at[good], matrix[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their length, safe for very large and very small components."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def hadamard(matrix: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = matrix.shape
    out, half = matrix.copy(), 1
    while half < width:
        view = out.reshape(rows, width // (2 * half), 2, half)
        a, b = view[:, :, 0, :] + view[:, :, 1, :], view[:, :, 0, :] - view[:, :, 1, :]
        view[:, :, 0, :], view[:, :, 1, :] = a, b
        half *= 2
    return out
