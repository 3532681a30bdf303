"""Small helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a function looks at in one go, so that long documents don't add up.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that ``column`` has about ``limit`` bytes in each piece, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives what is free but still held back to the system: that of Arrow's pool, and that of the C library's heap, where numpy's arrays were.

    Workers live on from stage to stage, and arrays of just under 32 MB otherwise leave holes that stay with them.
    """
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
