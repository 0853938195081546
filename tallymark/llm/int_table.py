"""A hash table of integers for whole arrays of keys at once."""

from __future__ import annotations

import numpy as np


class IntTable:
    """Open addressing over keys >= 0; grows by doubling, half full at most."""

    def __init__(self, dtype, bits: int = 16):
        self.dtype, self.bits, self.used = dtype, bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, dtype)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it belongs."""
        mask = (1 << self.bits) - 1
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        held = self.keys[slot]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            held = self.keys[slot[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return slot

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        slot = self.slots(keys)
        return np.where(self.keys[slot] == keys, self.values[slot], self.dtype(default))

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[self.slots(keys)] == keys

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and not there yet."""
        while self.used + len(keys) > 1 << (self.bits - 1):
            full = self.keys >= 0
            old, told = self.keys[full], self.values[full]
            self.__init__(self.dtype, self.bits + 1)
            self._place(old, told)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.used += len(keys)
        while len(keys):
            slot = self.slots(keys)
            _, first = np.unique(slot, return_index=True)  # of those that want one free slot, the first has it
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]
