"""What Python workers keep from one task to the next, and when they give memory back.

A worker serves the tasks of all operators in turn. It keeps one operator's tables at a time:
asking for another's drops them first. After each task the memory that the task has freed goes
back to the operating system, as an executor's limit counts what its idle workers still hold.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The value of ``make()``, kept until another key is asked for."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
