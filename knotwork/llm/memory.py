"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches that needs no encoder: frees those of earlier tasks before it, and its own memory after."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        from .encoding import release

        release()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied
