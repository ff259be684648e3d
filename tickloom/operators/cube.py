"""Sums for every combination of filter levels, from cumulative sums along the dimensions of a cube.

A filter dimension with levels v1 <= v2 <= ... lets a row pass the first few of them, so the sum at a level is the sum over all rows
that reach it: one suffix sum along the dimension. Rows first collapse to the sets of levels they pass (bit masks); a
group's few distinct masks are put into a dense cube at their highest levels, and each dimension is summed up once, whatever the number
of rows. Dimensions whose levels are not nested (bands, flags) are spread by a small 0/1 matrix instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: cells of one dense cube; leading dimensions are split off until the others fit
MOST_CELLS = 1 << 18


@dataclass(frozen=True)
class Dim:
    """One filter dimension: which of its ``labels`` a row satisfies, as a bit mask column. ``nested``: a row satisfies the first few."""

    name: str
    labels: tuple
    mask: Column
    nested: bool = False

    @staticmethod
    def floors(name: str, value: Column, levels: Sequence[float]) -> "Dim":
        bits = [F.when(value >= F.lit(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(levels)]
        return Dim(name, tuple(levels), _total(bits), list(levels) == sorted(levels))

    @staticmethod
    def flag(name: str, value: Column) -> "Dim":
        """true / false / either; a null flag satisfies only 'either'."""
        return Dim(name, ("true", "false", "either"), F.when(value, F.lit(1)).when(~value, F.lit(2)).otherwise(F.lit(0)) + F.lit(4))

    @staticmethod
    def bands(name: str, value: Column, bands: Sequence[tuple[float, float]], labels: Sequence) -> "Dim":
        bits = [F.when((value >= F.lit(lo)) & (value < F.lit(hi)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (lo, hi) in enumerate(bands)]
        return Dim(name, tuple(labels), _total(bits))

    def of(self, mask: Column) -> "Dim":
        """The dimension over a column that holds the mask."""
        return Dim(self.name, self.labels, mask, self.nested)


def _total(bits: list[Column]) -> Column:
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


@dataclass(frozen=True)
class Best:
    """Keep of each cube only cells that can be among the ``k`` best by ``name``, at ``least`` or more, for each label of the dimension ``per``. Ties stay."""

    name: str
    k: int
    least: int
    per: str | None = None


def _places(dims: Sequence[Dim]) -> list[tuple[str, int, int]]:
    """(holder column, bit offset, mask) of each dimension; a holder is a long with at most 62 bits."""
    places, holder, offset = [], 0, 0
    for d in dims:
        if offset + len(d.labels) > 62:
            holder, offset = holder + 1, 0
        places.append((f"_m{holder}", offset, (1 << len(d.labels)) - 1))
        offset += len(d.labels)
    return places


def dense_sums(masks: Sequence[np.ndarray], dims: Sequence[Dim], values: np.ndarray) -> np.ndarray:
    """An array of the dimensions' sizes: sums of ``values`` over the rows whose mask has the cell's bit in every dimension."""
    at, spread = [], []
    for m, d in zip(masks, dims):
        if d.nested:
            at.append(np.log2(m + 1).round().astype(np.int64) - 1)
            spread.append(None)
        else:
            found, place = np.unique(m, return_inverse=True)
            at.append(place)
            spread.append(np.array([[(int(x) >> i) & 1 for x in found] for i in range(len(d.labels))], values.dtype))
    shape = [len(d.labels) if s is None else s.shape[1] for d, s in zip(dims, spread)]
    cube = np.zeros(prod(shape), values.dtype)
    np.add.at(cube, np.ravel_multi_index(at, shape) if at else np.zeros(len(values), np.int64), values)
    cube = cube.reshape(shape)
    for i, s in enumerate(spread):
        if s is None:
            cube = np.flip(np.cumsum(np.flip(cube, i), i), i)
        else:
            cube = np.moveaxis(np.tensordot(s, cube, (1, i)), 0, i)
    return cube


def filter_grid(rows: DataFrame, dims: Sequence[Dim], by: Sequence[str], sums: dict[str, Column], best: Best | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """Sums per filter combination (only combinations that some row satisfies).

    1. Rows collapse to (by, masks of all dimensions): partial sums, at most as many rows as there are distinct masks, whatever the
       number of trades.
    2. Leading dimensions are expanded to their labels until a cube of the others has ``most_cells`` at most; one shuffle by (by, those labels).
    3. Each group's masks become a dense cube with a suffix sum along every dimension; its cells come back by number.

    A group is never larger than its number of distinct masks. Sums are longs or doubles; nulls count as 0.
    """
    places = _places(dims)
    holders = list(dict.fromkeys(p[0] for p in places))

    def packed(holder: str) -> Column:
        out = F.lit(0).cast("long")
        for d, (where, off, _) in zip(dims, places):
            if where == holder:
                out = out.bitwiseOR(F.shiftleft(d.mask.cast("long"), off))
        return out.alias(holder)

    collapsed = rows.select(*by, *[packed(h) for h in holders], *[c.alias(n) for n, c in sums.items()])
    for where, off, m in places:
        collapsed = collapsed.where(F.col(where).bitwiseAND(F.lit(m << off)) != 0)
    cells = collapsed.groupBy(*by, *holders).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])

    outer = 0
    while prod(len(d.labels) for d in dims[outer:]) > most_cells:
        outer += 1
    for i, (d, (where, off, _)) in enumerate(zip(dims[:outer], places)):
        cells = cells.withColumn(f"_o{i}", F.explode(F.array(*[F.lit(x) for x in range(len(d.labels))]))).where(F.expr(f"(shiftright({where}, {off} + _o{i}) & 1) = 1"))
    inner, inner_places = dims[outer:], places[outer:]
    keys = [*by, *[f"_o{i}" for i in range(outer)]]
    kinds = {n: cells.schema[n].dataType for n in sums}
    names, inner_dims = list(sums), [Dim(d.name, d.labels, None, d.nested) for d in inner]  # columns stay on the driver
    per = next((i for i, d in enumerate(inner) if best and d.name == best.per), None)

    def cube(table: pa.Table) -> pa.Table:
        masks = [(table.column(where).to_numpy() >> off) & m for where, off, m in inner_places]
        full = dense_sums(masks, inner_dims, np.ones(table.num_rows, np.int64)) > 0
        found = {n: dense_sums(masks, inner_dims, table.column(n).to_numpy()) for n in names}
        if best:
            values = found[best.name]
            full &= values >= best.least
            parts = [slice(None)] if per is None else [(slice(None),) * per + (i,) for i in range(values.shape[per])]
            for part in parts:
                some = values[part][full[part]]
                if len(some) > best.k:
                    full[part] &= values[part] >= np.partition(some, -best.k)[-best.k]
        at = np.flatnonzero(full)
        columns = [pa.array([table.column(c)[0].as_py()] * len(at), table.schema.field(c).type) for c in keys]
        return pa.Table.from_arrays([*columns, pa.array(at, pa.int64()), *(pa.array(found[n].reshape(-1)[at]) for n in names)], [*keys, "_cell", *names])

    schema = T.StructType([cells.schema[c] for c in keys] + [T.StructField("_cell", T.LongType())] + [T.StructField(n, kinds[n]) for n in sums])
    out = cells.groupBy(*keys).applyInArrow(cube, schema)

    def label(d: Dim, number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in d.labels]), number.cast("int") + 1).alias(d.name)

    labels, step = [label(d, F.col(f"_o{i}")) for i, d in enumerate(dims[:outer])], prod(len(d.labels) for d in inner)
    for d in inner:
        step //= len(d.labels)
        labels.append(label(d, F.expr(f"(_cell div {step}) % {len(d.labels)}")))
    return out.select(*by, *labels, *sums)
