"""Ordered running operators that never put a whole group into one task.

A plain window sorts each group inside a single task. Where one ticker, day or file may hold a large
share of all rows, the group is cut into blocks (for example half hours of a day, or runs of lines of
a file). Blocks are processed in parallel; only one summary row per block crosses blocks:

    rows --(keys, block)--> window inside the block ------------------+--> result
      \\--(keys, block)--> one total per block --(keys)--> carry-in --/

The second window sees one row per block, so its size depends on the length of a day or file in
blocks, not on the number of rows. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import stage

HALF_HOUR = 1800


def time_block(sec: Column | str = "sec", width: int = HALF_HOUR) -> Column:
    sec = F.col(sec) if isinstance(sec, str) else sec
    return F.floor(sec / F.lit(width)).cast("long")


def in_ranges(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """``df`` as a written table with a block column cut where the data lie: ranges of equal size along ``order``, numbered upwards.

    For orders over all tickers or a whole history, where blocks of time would be as uneven as trading is: a half hour with most rows
    is many ranges. ``order`` should tell rows apart, as equal ones stay in one range.
    """
    return stage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("long")))


def _block_window(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _join_blocks(df: DataFrame, carry: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    # inner join: every row's block has exactly one summary row
    return df.join(carry, [*keys, block], "inner")


def running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums over the rows of ``keys`` in ``order``.

    ``block`` must not decrease along ``order``. ``sums`` maps output names to summed expressions.
    """
    names = list(sums)
    work = df.withColumn("_blk", block)
    for n in names:
        work = work.withColumn(f"_v_{n}", sums[n])
    totals = work.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_blk", *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in names])
    inside = _block_window([*keys, "_blk"], order).rowsBetween(Window.unboundedPreceding, 0)
    local = work
    for n in names:
        local = local.withColumn(n, F.sum(f"_v_{n}").over(inside))
    out = _join_blocks(local, carry, keys, "_blk")
    for n in names:
        out = out.withColumn(n, F.coalesce(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), F.col(f"_c_{n}")))
    return out.drop("_blk", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def row_numbers(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence, name: str = "rn") -> DataFrame:
    """row_number() over ``keys`` in ``order`` as a running count."""
    return running_sum(df, keys, block, order, {name: F.lit(1).cast("long")})


def carry_both(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: Column, back: str, ahead: str) -> DataFrame:
    """``carry_value`` in both directions at once: the nearest non-null ``value`` at or before the row (``back``) and at or after it (``ahead``)."""
    work = df.withColumn("_blk", block).withColumn("_val", value)
    seen = F.when(F.col("_val").isNotNull(), F.struct(*order))
    edges = work.groupBy(*keys, "_blk").agg(F.max_by("_val", seen).alias("_last"), F.min_by("_val", seen).alias("_first"))
    local, carry = work, edges
    for turn, edge, name in ((F.asc, "_last", back), (F.desc, "_first", ahead)):
        across = Window.partitionBy(*keys).orderBy(turn("_blk")).rowsBetween(Window.unboundedPreceding, -1)
        inside = _block_window([*keys, "_blk"], [turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        carry = carry.withColumn(f"_carry{edge}", F.last(edge, ignorenulls=True).over(across))
        local = local.withColumn(name, F.last("_val", ignorenulls=True).over(inside))
    out = _join_blocks(local, carry.drop("_last", "_first"), keys, "_blk")
    return out.withColumn(back, F.coalesce(back, "_carry_last")).withColumn(ahead, F.coalesce(ahead, "_carry_first")).drop("_blk", "_val", "_carry_last", "_carry_first")


def carry_value(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    value: Column,
    name: str,
    forward: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Nearest non-null ``value`` looking back (or ``forward``) along ``order``.

    Without ``inclusive`` the row itself is not looked at, which gives lag / lead over non-null values.
    """
    work = df.withColumn("_blk", block).withColumn("_val", value)
    sort_key = F.struct(*order)
    seen = F.when(F.col("_val").isNotNull(), sort_key)
    pick = F.min_by("_val", seen) if forward else F.max_by("_val", seen)
    edges = work.groupBy(*keys, "_blk").agg(pick.alias("_edge"))
    # Looking ahead is done as looking back in reverse order: a frame that only grows is evaluated
    # incrementally, a frame up to unboundedFollowing would be recomputed for every row.
    turn = F.desc if forward else F.asc
    across = Window.partitionBy(*keys).orderBy(turn("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    inside = _block_window([*keys, "_blk"], [turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    carry_col = F.last("_edge", ignorenulls=True).over(across)
    near = F.last("_val", ignorenulls=True).over(inside)
    carry = edges.select(*keys, "_blk", carry_col.alias("_carry"))
    local = work.withColumn("_near", near)
    return (
        _join_blocks(local, carry, keys, "_blk")
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_blk", "_val", "_near", "_carry")
    )
