"""Ids of many repeated text units: each distinct unit is encoded once and then read off a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: How ``encode`` packs the ids of a unit: little-endian, 32 bits each.
PACKED = "<i4"


class _Index(dict):
    """Numbers units in order of first use and remembers the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number


class UnitTable:
    """Ids of units by ``encode``, which gets distinct units and returns the packed ids of each.

    The table serves the next calls as well. It starts anew once it holds more than ``limit``
    units, which bounds a worker's memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 400_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._index = _Index()
        self._flat, self._starts, self._used = np.zeros(1 << 12, np.int32), np.zeros(1, np.int64), 0

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in order, and how many each unit has."""
        if len(self._index) > self._limit:
            self._clear()
        at = np.fromiter(map(self._index.__getitem__, units), np.int64, len(units))
        if self._index.new:
            found = list(self._encode(self._index.new))
            self._index.new = []
            counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ends = self._used + np.cumsum(counts)
            if len(self._flat) < ends[-1]:
                grown = np.zeros(int(ends[-1]) * 3 // 2, np.int32)
                grown[: self._used] = self._flat[: self._used]
                self._flat = grown
            self._flat[self._used : ends[-1]] = np.frombuffer(b"".join(found), PACKED)
            self._used = int(ends[-1])
            self._starts = np.concatenate([self._starts, ends])
        counts = self._starts[at + 1] - self._starts[at]
        return take_slices(self._flat, self._starts[at], counts), counts


def take_slices(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices values[start : start + count], one after the other."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return values[np.repeat(shift, counts) + np.arange(total)]
