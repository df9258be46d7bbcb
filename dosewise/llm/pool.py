"""What a worker keeps between texts: one store at a time, with a limit in bytes."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from itertools import chain
from typing import TypeVar

import numpy as np

Encoded = tuple[np.ndarray, np.ndarray]
Store = TypeVar("Store")

#: Bytes that a unit takes beside its characters and ids, and the length from which on it is not kept.
UNIT_BYTES, LONG = 200, 64

_OPEN: dict[Hashable, object] = {}


def opened(key: Hashable, make: Callable[[], Store]) -> Store:
    """This worker's store of that key, made when it is first asked for; a store of another key is dropped for it.

    Workers live longer than a stage of a pipeline: without this each would keep what all its stages have stored.
    """
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = make()
    return _OPEN[key]


class Numbers(dict):
    """Numbers units in the order in which they are first asked for; ``new`` lists those not seen before."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def taken(self) -> tuple[list[str], int]:
        """The new units, of which the long ones are forgotten again, and the bytes that keeping the others takes."""
        new, self.new = self.new, []
        sizes = list(map(len, new))
        kept = UNIT_BYTES * len(new) + sum(sizes)
        if max(sizes, default=0) > LONG:
            for unit in (u for u, size in zip(new, sizes) if size > LONG):
                number = self.pop(unit)
                self[number] = number  # the place stays taken, so later numbers do not change
                kept -= len(unit)
        return new, kept


class UnitPool:
    """Ids of units in one growing array; it starts again beyond ``limit`` bytes, the ids of long units among them."""

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.size = 0

    def lookup(self, texts: list[list[str]]) -> Encoded:
        """Ids of texts given as lists of units, in one array, and where each text starts, with the end as last."""
        if self.size > self.limit:
            self._clear()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        unit = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.known.new:
            new, kept = self.known.taken()
            ids, starts = self.encode(new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.ids = np.concatenate([self.ids, ids])
            self.size += kept + ids.nbytes + starts.nbytes
        first, sizes = self.starts[unit], np.diff(self.starts)[unit]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(first - ends[:-1], sizes)
        flat += np.arange(ends[-1])
        return self.ids[flat], ends[np.concatenate([[0], np.cumsum(counts)])]
