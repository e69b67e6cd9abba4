"""What worker processes keep from one task to the next, which runs in the same process, maybe for another stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa

V = TypeVar("V")
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], V]) -> V:
    """make()'s value, one for each key, until a task that releasing() wraps begins in this process."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def given_back(table: pa.Table) -> pa.Table:
    """A group's table, once what was freed on the way to it has gone back."""
    give_back()
    return table


def giving_back(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work on a task's batches, after which freed memory goes back; what is kept stays."""

    @wraps(work)
    def run(*args: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args)
        finally:
            give_back()

    return run


def releasing(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """As giving_back, for work that needs nothing of what other stages keep: that goes first."""

    @wraps(work)
    def run(*args: object) -> Iterator[pa.RecordBatch]:
        if _kept:
            _kept.clear()
            give_back()
        yield from giving_back(work)(*args)

    return run
