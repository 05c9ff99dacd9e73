"""Arrow batches inside tasks: cut into pieces of bounded size, and memory that goes back when a task ends."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes of text that a worker works on at once


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices whose texts hold about `most` bytes together; a longer text makes a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def released(run):
    """A function of batches whose memory comes from the system and goes back once it has ended, as workers are used again."""

    @functools.wraps(run)
    def inner(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # its own pool would keep what a batch took for as long as the worker lives
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return inner
