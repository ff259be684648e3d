"""Arrays of a fixed size that all rows add to: counts and bit sets. Only the finished array comes to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PARTS = 32
_SCHEMA = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])
_DDL = "part int, salt int, data binary"


def _merged(rows: DataFrame, cells: int, kind: np.dtype, fill: Callable[[np.ndarray, pa.RecordBatch], None], both: Callable) -> np.ndarray:
    """``fill`` puts the rows of a batch in a task's array; arrays meet part by part, first within 64 salts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, kind)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                fill(total, batch.slice(at, 1000))
        found = [(i, x.tobytes()) for i, x in enumerate(np.split(total, _PARTS)) if x.any()]
        salt = sum(len(x) * (i + 1) + x[0] + x[-1] for i, x in found) % 64
        yield pa.RecordBatch.from_pydict({"part": [i for i, _ in found], "salt": [salt] * len(found), "data": [x for _, x in found]}, schema=_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), kind)
                sums[part] = both(sums[part], x) if part in sums else x.copy()
        yield pa.RecordBatch.from_pydict({"part": list(sums), "salt": [0] * len(sums), "data": [x.tobytes() for x in sums.values()]}, schema=_SCHEMA)

    out = np.zeros((_PARTS, cells // _PARTS), kind)
    for r in rows.mapInArrow(local, _DDL).repartition("part", "salt").mapInArrow(merge, _DDL).repartition("part").mapInArrow(merge, _DDL).collect():
        out[r["part"]] = both(out[r["part"]], np.frombuffer(r["data"], kind))
    return out.reshape(-1)


def counts(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How many of all ``hashes`` (unsigned 64-bit) fall in each of 2**bits cells, by their leading bits."""
    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        h = hashes(batch)
        if len(h):
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)

    return np.minimum(_merged(rows, 1 << bits, np.dtype(np.int64), fill, np.add), np.iinfo(np.int32).max).astype(np.int32)


def bit_set(rows: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed; those of the hashes in the first column (long) are set."""
    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        np.bitwise_or.at(total, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return _merged(rows, 1 << (bits - 3), np.dtype(np.uint8), fill, np.bitwise_or)


def has(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes may be in the set: all that are, and a share of the others as large as that of set bits."""
    bits = len(packed).bit_length() + 2
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
