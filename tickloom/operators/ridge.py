"""Weighted ridge regression from sufficient statistics, and its stored form.

Weighted cross-products of the columns, added up once per fold, hold everything that every training set and every penalty needs:
a training set's sums are those of all rows less those of its held fold. Only matrices of the columns' number come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Ridge:
    """intercept + sum of coefficients times columns."""

    columns: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for name, b in zip(self.columns, self.coefficients):
            out = out + F.lit(b) * F.col(name)
        return out


def fold_sums(df: DataFrame, fold: str, inputs: Sequence[str], width: int, local: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each fold the sum of ``local(fold, rows)``, a vector of ``width`` numbers, over pieces of its rows (a matrix of ``inputs``).

    Rows with a null or NaN input are left out. Tasks add up first; a fold's vectors are then added by position.
    """
    names = list(inputs)
    whole = df
    for c in names:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            rows = np.stack([batch.column(i + 1).to_numpy() for i in range(len(names))], 1)
            for f in np.unique(folds).tolist():
                part = local(f, rows[folds == f])
                sums[f] = sums[f] + part if f in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["fold", "sums"])

    parts = whole.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, "fold int, sums array<double>")
    added = parts.select("fold", F.posexplode("sums").alias("at", "x")).groupBy("fold", "at").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # folds times width
        out.setdefault(r["fold"], np.zeros(width))[r["at"]] = r["x"]
    return out


def moments(df: DataFrame, fold: str, columns: Sequence[str], y: str, weight: str) -> dict[int, np.ndarray]:
    """For each fold the weighted cross-products of (1, columns, y), a square matrix."""
    size = len(columns) + 2

    def local(_: int, rows: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.ones((len(rows), 1)), rows[:, :-1]], 1)
        return ((z * rows[:, -1:]).T @ z).reshape(-1)

    return {f: x.reshape(size, size) for f, x in fold_sums(df, fold, [*columns, y, weight], size * size, local).items()}


def solve(m: np.ndarray, columns: Sequence[str], penalty: float) -> Ridge:
    """The minimum of half the mean squared error plus half the penalty times the squared coefficients, both of standardized values.

    ``m`` are the cross-products of (1, columns, y). Columns that don't vary get 0.
    """
    d = len(columns)
    total = m[0, 0]
    mean = m[0, 1:] / total
    cov = m[1:, 1:] / total - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.abs(mean) + std
    use = np.flatnonzero(std[:d] > 1e-9 * np.where(scale[:d] > 0, scale[:d], 1.0))
    beta = np.zeros(d)
    if std[d] > 0 and len(use):
        a = cov[np.ix_(use, use)] / np.outer(std[use], std[use])
        b = cov[use, d] / (std[use] * std[d])
        beta[use] = np.linalg.lstsq(a + penalty / std[d] * np.eye(len(use)), b, rcond=None)[0] * std[d] / std[use]
    return Ridge(tuple(columns), tuple(beta.tolist()), float(mean[d] - mean[:d] @ beta))


def held_errors(df: DataFrame, fold: str, models: dict[int, Sequence[Ridge]], y: str, weight: str, back: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each fold the weighted mean absolute error of its models (one per penalty) on its own rows, all in one pass; ``back`` maps predictions to ``y``."""
    columns = next(iter(models.values()))[0].columns
    n = len(next(iter(models.values())))
    slopes = {f: np.array([m.coefficients for m in some]).T for f, some in models.items()}
    starts = {f: np.array([m.intercept for m in some]) for f, some in models.items()}

    def local(f: int, rows: np.ndarray) -> np.ndarray:
        x, target, w = rows[:, :-2], rows[:, -2:-1], rows[:, -1]
        return np.append(w @ np.abs(back(x @ slopes[f] + starts[f]) - target), w.sum())

    return {f: x[:-1] / x[-1] for f, x in fold_sums(df, fold, [*columns, y, weight], n + 1, local).items()}


# ---------------------------------------------------------------- stored models

_STORED = "columns array<string>, coefficients array<double>, intercept double, smearing double, model_name string, version_id string"


def save_ridge(spark: SparkSession, path: str, name: str, version: str, model: Ridge, smearing: float = 1.0) -> None:
    """One more version of the model ``name`` in the table of models at ``path``. A version that is there already is written anew."""
    row = spark.createDataFrame([(list(model.columns), list(model.coefficients), model.intercept, smearing, name, version)], _STORED)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "version_id").parquet(path)


def load_ridge(spark: SparkSession, path: str, name: str, version: str | None = None) -> tuple[Ridge, float, str]:
    """(model, smearing factor, version) of ``name``; without ``version`` the highest one."""
    kept = spark.read.schema(_STORED).parquet(path).where(F.col("model_name") == name)
    order = F.col("version_id").cast("decimal(10,4)")
    found = (kept.where(F.col("version_id").cast("decimal(10,4)") == F.lit(version).cast("decimal(10,4)")) if version else kept.orderBy(F.desc(order))).first()
    if found is None:
        raise ValueError(f"no stored model {name} {version or ''}")
    return Ridge(tuple(found["columns"]), tuple(found["coefficients"]), found["intercept"]), found["smearing"], str(found["version_id"])
