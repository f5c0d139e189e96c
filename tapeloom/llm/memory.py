"""What a Python worker gives back to the system when a task has used it."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Return freed Arrow buffers and heap pages; workers live on and idle ones would keep them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
