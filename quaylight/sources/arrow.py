"""Byte views of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without copies; a null is empty."""
    column = column.fill_null(b"") if column.null_count else column
    large = pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * width).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
