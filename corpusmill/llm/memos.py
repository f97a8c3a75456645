"""Memos of Python workers: one operator's at a time, as workers outlive operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
Batches = Iterator[pa.RecordBatch]
_HELD: dict[str, object] = {}


def claim(owner: str, make: Callable[[], T]) -> T:
    """This worker's memo for an owner; other owners' memos go first."""
    found = _HELD.get(owner)
    if found is None:
        _HELD.clear()
        found = _HELD[owner] = make()
    return found


def trim() -> None:
    """Gives the memory a worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(owner: str | None, work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Arrow work whose worker first drops the memos of other owners and gives memory back at the end of each task.

    Work that claims its own memo names no owner.
    """

    def run(batches: Batches) -> Batches:
        if owner:
            claim(owner, dict)
        try:
            yield from work(batches)
        finally:
            trim()

    return run
