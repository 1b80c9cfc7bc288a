"""Memory of Python workers: what a task has freed goes back to the system at once.

A worker outlives its tasks. By default the C library keeps freed arrays of up to 32 MB for later, so that a worker
holds the peak of every task it ever ran while the next stage needs the executor's memory for something else.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import wraps

import pyarrow as pa

MAPPED = 1 << 20  # blocks from this size on are mapped, and unmapped when freed
_MMAP_THRESHOLD = -3  # mallopt's name for it


def _library():
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "mallopt") and hasattr(library, "malloc_trim") else None
    except OSError:  # another C library: its own rules hold
        return None


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that leaves no freed memory behind in its worker, ended or broken off."""

    @wraps(run)
    def bounded(batches):
        library = _library()
        if library is not None:
            library.mallopt(_MMAP_THRESHOLD, MAPPED)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if library is not None:
                library.malloc_trim(0)

    return bounded
