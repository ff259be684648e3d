"""Rounding and safe arithmetic.

The results to match were computed with NumPy, whose ``round(x, n)`` is ``rint(x * 10**n) / 10**n``
(half to even on the scaled double). Spark's own ``round`` works on the decimal text and differs on
ties, so every rounded double goes through :func:`round_to`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(c: Column | str, digits: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    # "+ 0.0" turns negative zero into zero
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def pct_of(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100, null when whole is 0 or null."""
    return round_to(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), digits)


def signed_change(entry: Column, price: Column, side: Column) -> Column:
    """Unrounded percent change in the direction of the trade; an unknown side is an error."""
    move = (price - entry) / entry * F.lit(100.0)
    against = (entry - price) / entry * F.lit(100.0)
    return (
        F.when(side == "buy", move)
        .when(side == "short", against)
        .otherwise(F.raise_error(F.concat(F.lit("unknown trade side: "), F.coalesce(side, F.lit("null")))).cast("double"))
    )


def roi(entry: Column, price: Column, side: Column) -> Column:
    """Return of a trade in percent, two decimals."""
    return round_to(signed_change(entry, price, side), 2)
