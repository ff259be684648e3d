"""Minimal perfect hashing of 64-bit keys: bit arrays by level, and ranks of their set bits."""

from __future__ import annotations

import numpy as np

from tickloom.llm.common import mix


class PerfectHash:
    """Maps n distinct keys to 0 .. n-1, each to its own number. ``keys`` holds the key of each number, so that others are told apart.

    On every level the keys that are alone in their cell set its bit and are done; the others go on to the next level. A key's number
    is the rank of its bit among all set ones.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        keys = np.unique(np.asarray(keys, np.uint64))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # number of cells; bits in words; set bits before each word
        left, before = keys, 0
        while len(left):
            cells = 64 * max(1, int(np.ceil(room * len(left) / 64)))
            at = self._cell(left, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((cells, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            left = left[~alone[at]]
        self.keys = np.zeros(len(keys), np.uint64)
        if len(keys):
            self.keys[self._numbers(keys)] = keys

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(cells)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (cells, words, before) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._cell(keys[open_], level, cells)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            set_ = (word >> bit) & np.uint64(1) == 1
            rank = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[set_]] = before[at[set_] >> 6] + rank[set_]
            open_ = open_[~set_]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that is none of them (its stored key differs)."""
        keys = np.asarray(keys, np.uint64)
        found = self._numbers(keys)
        hit = found >= 0
        hit[hit] = self.keys[found[hit]] == keys[hit]
        return np.where(hit, found, -1)
