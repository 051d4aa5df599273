"""Minimal perfect hashing of fixed-width keys, built and looked up by numpy passes."""

from __future__ import annotations

import numpy as np

from ._text import U64, mix

#: Bits of a level for each key that is still without a slot.
GAMMA = 2


class SlotTable:
    """Slots 0 .. n-1 for n distinct keys (rows of int64 columns).

    A level has ``GAMMA`` bits for each key left; keys that are alone on their bit are placed, the
    others go to the next level. A slot is the rank of its bit among the set bits of all levels.
    The key of each slot is kept, and a lookup compares it, so a key that is not in the table,
    or that only shares hashes with one, gets -1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.n = len(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = np.zeros_like(keys)
        left, base = np.arange(self.n), 0
        while len(left):
            size = max(8, GAMMA * len(left))
            at = self._places(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            placed = alone[at]
            self.keys[rank[at[placed]]] = keys[left[placed]]
            base += int(placed.sum())
            left = left[~placed]
            if len(self.levels) > 64:
                raise ValueError("keys of a slot table must be distinct")

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), U64)
        for k in range(keys.shape[1]):
            h = mix(h ^ keys[:, k].astype(np.int64).view(U64))
        return (h % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[left], level, len(alone))
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        found = np.flatnonzero(out >= 0)
        wrong = (self.keys[out[found]] != keys[found]).any(axis=1)
        out[found[wrong]] = -1
        return out
