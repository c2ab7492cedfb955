"""Python workers that give back what a task held.

Spark keeps its Python workers between tasks, so caches and freed arrays of
one stage would count against the executor's memory in the stages behind it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Return unused memory of the process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: freed memory stays with the process


def lean(run: Callable[[Iterator], Iterator], *clear: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` (for ``mapInArrow``), with caches cleared and memory returned
    when a task's rows are done."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for forget in clear:
                forget()
            release()
    return tidy


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
