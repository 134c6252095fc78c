"""Arrow batches within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Files or documents that are Python objects at a time.
AT_ONCE = 64


def slices(batches: Iterator[pa.RecordBatch], size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows, so that what is made of them is bounded too."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
