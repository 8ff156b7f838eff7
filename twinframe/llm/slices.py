"""Parts of Arrow batches that hold a bounded number of rows and bytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def slices(batch, column: str, rows: int, size: int = 4 << 20) -> Iterator:
    """Consecutive parts of a record batch, of at most ``rows`` rows and ``size`` bytes in ``column``; a longer text is a part alone."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop
