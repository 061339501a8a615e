"""Whole-number components of vectors as numpy arrays, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TYPES = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<f8"))


def floored(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite components, and for those a matrix of floor(scale * component) as doubles.

    A vector is left out if it is null or a component is null, not finite, or not finite once scaled. Shorter vectors end in zeros.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * values)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    kept = np.array(column.is_valid().to_numpy(zero_copy_only=False), bool)
    kept[rows[~np.isfinite(values)]] = False
    inside = kept[rows]
    matrix = np.zeros((int(kept.sum()), int(lengths[kept].max(initial=0))))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix[(np.cumsum(kept) - 1)[rows[inside]], place[inside]] = values[inside]
    return kept, matrix


def packed(matrix: np.ndarray) -> tuple[bytes, str]:
    """The matrix of whole numbers in the smallest of a few types, and the type's name."""
    top = np.abs(matrix).max(initial=0)
    kind = _TYPES[0] if top < 1 << 15 else _TYPES[1] if top < 1 << 31 else _TYPES[2]
    return matrix.astype(kind).tobytes(), kind.str


def unpacked(data: bytes, kind: str, rows: int) -> np.ndarray:
    """The matrix that :func:`packed` made."""
    return np.frombuffer(data, kind).reshape(rows, -1) if rows else np.zeros((0, 0))


def whole_numbers(values: np.ndarray, bound: float) -> np.ndarray:
    """The values as integers wide enough for results up to ``bound``: 32 or 64 bits, else Python's."""
    if bound < 2.0 ** 31:
        return values.astype(np.int32)
    if bound < 2.0 ** 62:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
