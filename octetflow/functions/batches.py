"""Arrow batches in stretches of few bytes: what a worker holds beside the batch grows neither with the batch nor with the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on, or given back, at once.
STRETCH = 4 << 20


def stretches(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of successive rows of ``most`` bytes together, or of one row that is larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + (most or STRETCH), "right")))
        yield lo, hi
        lo = hi


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; of a null none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
