"""A hash table from whole numbers to whole numbers whose lookups are vectorised."""

from __future__ import annotations

import numpy as np

_FREE = np.int64(-1)


class IntTable:
    """Open addressing with linear probing; keys are non-negative, missing keys give -1."""

    def __init__(self, keys: np.ndarray = (), values: np.ndarray = ()) -> None:
        self.size = 0
        self._make(16)
        self.add(np.asarray(keys, np.int64), np.asarray(values, np.int64))

    def _make(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _FREE)
        self.values = np.full(1 << bits, -1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not hold yet."""
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            held = self.keys != _FREE
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self._make(int(self.size * 3).bit_length())
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[free]  # one of those that want the same place gets it
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero((held != keys) & (held != _FREE))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            out[open_] = self.values[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != _FREE)]
        return out
