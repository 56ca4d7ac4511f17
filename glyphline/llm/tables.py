"""Exact vectorised lookup of 64-bit keys."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Position of keys in a list of distinct uint64 keys, -1 if absent; open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(4 * len(keys) - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        todo = np.arange(len(keys), dtype=np.int64)
        at = self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            # of several keys that want one free slot, the last written stays
            self.slot[at[free]] = todo[free]
            won = self.slot[at] == todo
            self.keys[at[won]] = keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.slot[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out
