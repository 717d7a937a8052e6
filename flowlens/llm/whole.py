"""Vectors in whole numbers: each component times a scale, rounded down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components beyond this count as not finite: sums of squared differences stay exact in 64 bits.
LIMIT = 1 << 26


def floored(column: pa.Array, scale: int = 256) -> tuple[np.ndarray, list[bytes | None]]:
    """The length of each vector and its components ``floor(scale * x)`` as 32-bit little-endian bytes.

    None for a vector that is null or holds a component that is null, not finite or beyond LIMIT.
    """
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * float(scale))
        bad = ~(np.abs(x) < LIMIT)
    row = np.repeat(np.arange(len(column)), length)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[bad], minlength=len(column)) == 0)
    whole = np.where(bad, 0, x).astype("<i4")
    ends = np.cumsum(length)
    return length, [whole[e - n : e].tobytes() if ok else None for ok, n, e in zip(usable, length, ends)]


def stacked(packed: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed vectors of ``width`` components as the rows of a matrix."""
    return np.frombuffer(b"".join(packed.to_pylist()), dtype="<i4").reshape(len(packed), width)
