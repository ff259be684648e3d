"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: bytes of text that a vectorized helper handles at once; a longer text is handled alone
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``size`` bytes each."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield at, stop
        at = stop


def parts(batch: pa.RecordBatch, column: str | int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes in a string column each, so that what a task derives from a batch stays small."""
    for a, b in slices(batch.column(column), size):
        yield batch.slice(a, b - a)


def unused(names: Sequence[str], name: str) -> str:
    """``name``, or it with underscores that make it none of ``names`` (letters' case aside)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
