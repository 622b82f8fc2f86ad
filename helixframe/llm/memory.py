"""What a Python worker remembers from one batch, and one task, to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

#: Bytes of an entry besides its key's own: objects, hash and place in the dictionary.
ENTRY = 200
#: Longest key that is remembered; longer ones are worked out each time.
LONGEST = 64

_held: dict = {}


class Remembered(dict):
    """``make(key)`` by key (bytes), within a number of bytes.

    What is over goes by halves: keys that were met since the last turn stay.
    """

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.half = make, most // 2
        self.room, self.old = self.half, {}

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if self.room <= 0:
            self.old, self.room = dict(self), self.half
            self.clear()
        self.room -= len(key) + ENTRY
        self[key] = value
        return value


def held(owner, make: Callable):
    """The worker's one memory: what ``make()`` gave, until another owner asks or it is forgotten.

    Workers serve one operator after the other, so memories of their own would
    add up.
    """
    if owner not in _held:
        forget()
        _held[owner] = make()
    return _held[owner]


def forget() -> None:
    """Empties the worker's memory and hands what is free back to the machine."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
