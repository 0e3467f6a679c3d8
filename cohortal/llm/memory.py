"""Python workers live on between tasks; what a task has freed goes back to the system at its end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run: Run) -> Run:
    """run, giving back at its end the memory that it has freed."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, *args, **kwargs)
        finally:
            give_back()

    return tidied
