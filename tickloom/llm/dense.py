"""Dense vectors that all tasks add to, summed as a tree; only the finished vector comes to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

_SLICES, _SALTS = 16, 64
_SCHEMA = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])
_DDL = "slice int, salt int, data binary"


def tree_sum(rows: DataFrame, size: int, kind: type, local: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of ``local(batches)``, a vector of ``size`` numbers of the type ``kind``.

    Vectors are cut in slices; those of a slice meet by 64 salts and then once more, so no task reads more than 64 vectors' slices
    after the first level and the driver gets each slice once. ``size`` must not depend on the number of rows.
    """
    step = max(1, -(-size // _SLICES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(local(batches), kind)
        found = [(i, total[i * step:(i + 1) * step]) for i in range(_SLICES)]
        found = [(i, x.tobytes()) for i, x in found if x.any()]
        salt = TaskContext.get().partitionId() % _SALTS
        yield pa.RecordBatch.from_pydict({"slice": [i for i, _ in found], "salt": [salt] * len(found), "data": [x for _, x in found]}, schema=_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("slice").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), kind)
                sums[i] = sums[i] + x if i in sums else x.copy()
        yield pa.RecordBatch.from_pydict({"slice": list(sums), "salt": [0] * len(sums), "data": [x.tobytes() for x in sums.values()]}, schema=_SCHEMA)

    out = np.zeros(size, kind)
    summed = rows.mapInArrow(first, _DDL).repartition("slice", "salt").mapInArrow(merge, _DDL).repartition("slice").mapInArrow(merge, _DDL)
    for r in summed.collect():  # a row per slice
        at = r["slice"] * step
        out[at:at + step] += np.frombuffer(r["data"], kind)
    return out
