"""Memory of Python workers.

Workers are used again by later tasks, also of other operators. What a task has freed goes back to
the system when it ends, so that workers that wait don't hold it, and what a worker remembers is
bounded in bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """What this worker keeps between tasks under a name."""
    return _HELD.setdefault(name, {})


def tidy(run: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow. It drops what a worker holds of other operators (all but ``keep``) before, and gives memory back after."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, what in _HELD.items():
            if name != keep:
                what.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


class Memo:
    """At most ``most`` bytes of strings and what is known about them; when full it takes no more."""

    #: About what an entry of a dictionary takes besides its text.
    ENTRY = 200

    def __init__(self, most: int):
        self.most, self.held, self.known = most, 0, {}

    def add(self, text: str, value) -> bool:
        """Whether there was room."""
        if self.held >= self.most:
            return False
        self.held += self.ENTRY + 4 * len(text)
        self.known[text] = value
        return True
