"""Operator 13: whitening of embeddings by the eigenvectors of their covariance.

Vectors become integers, and the fit list holds each distinct integer vector once. Sums are exact; the covariance is a tree of the
tasks' dense matrices of centred vectors. Its float32 eigenvectors are corrected to double precision (``eigen.py``). Only
matrices of the vectors' width reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.dense import tree_sum
from tickloom.llm.eigen import refined_eigen
from tickloom.session import stage

#: vectors handled at once in a task
ROWS = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integer_vectors(vectors: DataFrame, unit: int = 256) -> DataFrame:
    """(vec_id, x): x = floor(unit * c) of each entry; rows without a vector or with null or non-finite entries go.

    Vectors of another width than most (the larger one at equal numbers), and empty ones, go too.
    """
    c = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0))
    kept = kept.where(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    widths = kept.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kept = kept.where(F.size("c") == (widths["width"] if widths else 0))
    return kept.select("vec_id", F.transform("c", lambda v: F.floor(unit * v).cast("long")).alias("x"))


def fit_list(found: DataFrame) -> DataFrame:
    """Each distinct vector of (vec_id, x) once, as (x). Copies meet in the tasks first, so a vector that holds a third of the rows is no hot key."""
    return found.select("x").distinct()


def vector_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each entry."""
    first = fit.select(F.size("x").alias("w")).first()
    if first is None:
        return 0, []
    row = fit.agg(F.count("*"), *(F.sum(F.get("x", F.lit(i))) for i in range(first["w"]))).first()
    return row[0], list(row[1:])


def covariance(fit: DataFrame, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the vectors, or of their projections (columns of ``project``), from centred vectors."""
    width = len(sums)
    mean = np.array([s / n for s in sums])
    out = width if project is None else project.shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((out, out))
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for at in range(0, len(x), ROWS):
                y = x[at:at + ROWS] - mean
                if project is not None:
                    y = y @ project
                total += y.T @ y
        return total.reshape(-1)

    return tree_sum(fit, out * out, np.float64, local).reshape(out, out) / n


def whiten(vectors: DataFrame, components: int = 4, unit: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component up to ``components``, from ``vectors`` (vec_id, embedding).

    Entries become integers x (see ``integer_vectors``), the fit list holds each distinct x once: n vectors with sums S. whitened is x - S/n projected
    on the component's unit eigenvector of the covariance, over the root of its eigenvalue; explained is the eigenvalue over the trace;
    deviation is the exact sum of (n*x - S)**2 (a value beyond 64 bits raises); identity_error the largest absolute entry of the whitened fit list's covariance
    minus the identity. With fewer dimensions than ``components`` there is one row per dimension. Where the eigenvalue is not above
    rounding (equal vectors), whitened is null, and explained too if the trace is 0. Rows that repeat, null ids and other
    columns change nothing but their own rows; an empty table gives no rows. Signs are fixed: a component's largest entry is positive.
    """
    spark = vectors.sparkSession
    found = integer_vectors(vectors, unit)
    fit = stage(fit_list(found))
    n, sums = vector_sums(fit)
    if not n:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    v = covariance(fit, n, sums)
    e, x = refined_eigen(v)
    top = min(components, len(sums))
    e, x, trace = e[:top], x[:, :top], float(np.trace(v))
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(top)] < 0, -1.0, 1.0)
    good = e > 1e-12 * trace if trace > 0 else np.zeros(top, bool)
    scale = x / np.sqrt(np.where(good, e, 1.0))
    error = float(np.abs(covariance(fit, n, sums, scale[:, good]) - np.eye(int(good.sum()))).max()) if good.any() else None
    mean, exact = np.array([s / n for s in sums]), np.array(sums, object)
    explained = (e / trace).tolist() if trace > 0 else [None] * top
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            rows = _matrix(batch.column("x"), width)
            away = n * rows.astype(object) - exact if n * np.abs(rows).max(initial=0) >= 2**31 else n * rows - exact.astype(np.int64)
            deviation = (away.astype(object) ** 2).sum(1) if float(np.abs(away).max(initial=0)) ** 2 * width >= 2.0**62 else (away * away).sum(1)
            projected = (rows - mean) @ scale
            out = {
                "vec_id": batch.column("vec_id").to_numpy(zero_copy_only=False).repeat(top) if not batch.column("vec_id").null_count else [i for i in batch.column("vec_id").to_pylist() for _ in range(top)],
                "component": np.tile(np.arange(1, top + 1, dtype=np.int32), len(rows)),
                "n": np.full(len(rows) * top, n),
                "deviation": [int(x) for x in deviation for _ in range(top)],
                "whitened": pa.array(projected.reshape(-1), pa.float64(), mask=np.tile(~good, len(rows))),
                "explained": explained * len(rows),
                "identity_error": [error] * (len(rows) * top),
            }
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    return found.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
