"""Python workers that serve many tasks: what they keep between them, and what they give back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """The object of this key, made once for each Python worker; one of another key is dropped."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drops what `once` keeps."""
    _kept.clear()


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits beside the executor holds little of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """run (for mapInArrow) in a worker that first drops what other operators kept there, unless run keeps an object
    of its own by `once`, and gives back what is free when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
