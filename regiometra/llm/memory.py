"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns what Arrow and the allocator hold but do not use, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(function: Callable) -> Callable:
    """``function`` of a group, or of two groups, with ``give_back`` when it is done; Spark counts its arguments."""
    def one(frame):
        try:
            return function(frame)
        finally:
            give_back()

    def both(left, right):
        try:
            return function(left, right)
        finally:
            give_back()

    return both if len(inspect.signature(function).parameters) == 2 else one


def batches_giving_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """As :func:`giving_back`, for a generator over the batches of a task."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
