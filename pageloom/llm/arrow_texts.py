"""Texts of an Arrow batch as one run of bytes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text taken together; a longer text is a slice of its own
SLICE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and the n + 1 places where texts start and end."""
    _, places, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(places, np.int64 if wide else np.int32) if places else np.zeros(1, np.int64)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends


def slices(ends: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of at most ``limit`` bytes, or a single row."""
    row, last = 0, len(ends) - 1
    while row < last:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, min(to, last)
        row = to


def text_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of texts out of their bytes and places."""
    places = pa.py_buffer(ends.astype(np.int32).tobytes())
    return pa.StringArray.from_buffers(len(ends) - 1, places, pa.py_buffer(np.ascontiguousarray(data)))


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of integer lists out of their values and lengths."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
