"""Hashed word shingles of whole texts, computed on the Arrow buffers of a batch.

Words are runs of characters other than space and 0x09-0x0D; A-Z count as a-z. 64-bit hashes stand for
shingles: two different shingles of a pair of texts are equal with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.common import mix, slices

_BYTES = np.arange(256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE = mix((_BYTES + np.where((_BYTES >= 65) & (_BYTES <= 90), np.uint64(32), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_CODE[_SPACE] = 0
_STEP = np.uint64(0xD1342543DE82EF95)
_NEXT = np.uint64(0x2545F4914F6CDD1D)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word index at which each row begins, with the end appended)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(raw, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = inside[rows]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = np.cumprod(np.full(int(spans.max()), _STEP, np.uint64))
    sums = np.add.reduceat(_CODE[data[starts[0]:]] * powers[place], starts - starts[0])
    return mix(sums), np.searchsorted(starts, offsets)


def _sequence(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each index in ``first`` on."""
    out = np.full(len(first), n, np.uint64)
    for i in range(n):
        out = out * _NEXT + hashes[first + i]
    return mix(out)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row.

    A text with fewer than ``words`` words has its whole word sequence as its one shingle; a null, an empty
    text and a text of white space have none.
    """
    out: list[np.ndarray] = []
    for a, b in slices(column):
        hashes, bounds = word_hashes(column.slice(a, b - a))
        runs = _sequence(hashes, np.arange(max(0, len(hashes) - words + 1)), words) if len(hashes) >= words else hashes[:0]
        for i, j in zip(bounds[:-1], bounds[1:]):
            n = int(j - i)
            if n >= words:
                out.append(np.unique(runs[i:j - words + 1]))
            elif n:
                out.append(_sequence(hashes, np.array([i]), n))
            else:
                out.append(hashes[:0])
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set of shingles."""
    n = np.array([len(tokens)], np.uint64)
    return int(mix(mix(mix(tokens) ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + n).view(np.int64)[0])
