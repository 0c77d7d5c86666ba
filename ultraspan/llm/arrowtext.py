"""Reading a text column of Arrow batches as UTF-8 bytes, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one longer text is handled on its own).
SLICE_BYTES = 1 << 20


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, offsets, bytes): row r of the slice is ``bytes[offsets[r]:offsets[r + 1]]``.
    A null text counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added, as ``withColumns`` does."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in new.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def added_schema(schema, new: str):
    """A Spark schema with the columns of the DDL string ``new`` replaced or added (see ``with_columns``)."""
    from pyspark.sql import types as T

    fields = {f.name: f for f in schema.fields}
    fields |= {f.name: f for f in T.StructType.fromDDL(new).fields}
    return T.StructType(list(fields.values()))
