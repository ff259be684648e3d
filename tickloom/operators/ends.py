"""Where a trade's path may end: the second by which all that an operator looks for has happened for sure.

An operator that is through with a trade after some hits says so as chains of ``Hit``. The search needs one row per ticker, day and second
(lowest and highest price) and one per trade; it never pairs trades with ticks, so nothing grows with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.session import SessionSpec

KEYS = ["ticker", "trade_date"]
#: percent by which a hit must be over its level: more than rounding to two decimals and the noise of doubles can take away
SURE = 0.01


@dataclass(frozen=True)
class Hit:
    """A tick with a return of at least ``level`` percent (at most, without ``up``), at or after second ``since`` (a column of the trades) + ``plus``.

    Without ``level`` any tick is a hit, but only if the seconds of the first ticks at or after ``since`` + ``plus`` and ``since`` + each of ``also`` have no tick
    without a price.
    """

    level: float | None = None
    up: bool = True
    since: str | None = None
    plus: int = 0
    also: tuple[int, ...] = ()


#: chains of hits, each in a later second than the one before it; the path may end with the end of the first chain
Chains = Sequence[Sequence[Hit]]


class Highest:
    """A binary tree of highest values: the first index at or after ``start`` with a value of at least ``bound``, for many of both."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.leaves = 1 << max(0, self.n - 1).bit_length()
        self.tree = np.full(2 * self.leaves, -np.inf)
        self.tree[self.leaves:self.leaves + self.n] = values
        size = self.leaves
        while size > 1:
            half = size // 2
            self.tree[half:size] = np.maximum(self.tree[size:2 * size:2], self.tree[size + 1:2 * size:2])
            size = half

    def first(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """``n`` where there is none. A bound of NaN is never reached."""
        out = np.full(len(start), self.n)
        left = np.flatnonzero(start < self.n)
        node = self.leaves + start[left]
        found, at = [], []
        while len(left):  # to the right, in subtrees that grow
            ok = self.tree[node] >= bound[left]
            found.append(left[ok])
            at.append(node[ok])
            left, node = left[~ok], node[~ok] + 1
            node //= node & -node
            left, node = left[node > 1], node[node > 1]  # 1: past the last leaf
        if found:
            who, node = np.concatenate(found), np.concatenate(at)
            inner = node < self.leaves
            while inner.any():  # down to the first leaf
                node[inner] *= 2
                node[inner] += ~(self.tree[node[inner]] >= bound[who[inner]])
                inner = node < self.leaves
            out[who] = np.minimum(node - self.leaves, self.n)
        return out


class Day:
    """The seconds of a ticker-day in order, with their lowest and highest price (NaN where no price is a number) and whether a tick has no price."""

    def __init__(self, sec: np.ndarray, lo: np.ndarray, hi: np.ndarray, bare: np.ndarray):
        self.sec, self.bare = sec, np.append(bare.astype(bool), False)
        self.up, self.down = Highest(np.where(np.isnan(hi), -np.inf, hi)), Highest(np.where(np.isnan(lo), -np.inf, -lo))

    def at(self, second: np.ndarray, side: str = "left") -> np.ndarray:
        """Index of the first second at or after ``second`` (after it, with ``right``); the number of seconds where there is none, or ``second`` is NaN."""
        return np.searchsorted(self.sec, second, side)

    def ends(self, entry: np.ndarray, price: np.ndarray, buy: np.ndarray, since: dict[str, np.ndarray], chains: Chains, sure: float = SURE) -> np.ndarray:
        """Index of the second in which the first chain of each trade ends. Nothing is sure of returns from a ``price`` that is not positive."""
        n = len(self.sec)
        base = np.where((price > 0) & np.isfinite(price), price, np.nan)
        ends = np.full(len(entry), n)
        for chain in chains:
            at = self.at(entry)
            for i, hit in enumerate(chain):
                if i:
                    at = np.where(at < n, self.at(self.sec[np.minimum(at, n - 1)], "right"), n)
                if hit.since:
                    at = np.maximum(at, self.at(since[hit.since] + hit.plus))
                if hit.level is None:
                    for second in (hit.plus, *hit.also) if hit.since else ():
                        at = np.where(self.bare[self.at(since[hit.since] + second)], n, at)
                    continue
                level = hit.level + (sure if hit.up else -sure)
                bound = base * (1 + np.where(buy, level, -level) / 100)
                rises = buy == hit.up  # the price must rise to the bound
                at = np.where(rises, self.up.first(at, np.where(rises, bound, np.nan)), self.down.first(at, np.where(rises, np.nan, -bound)))
            ends = np.minimum(ends, at)
        return ends


def per_second(ticks: DataFrame, session: SessionSpec) -> DataFrame:
    """One row per ticker, day and second of the session: lowest and highest price (null where no price is a number), the price of the first tick (null
    where a tick has no id), and whether a price is NaN or null. The rows of a ticker-day are in one task."""
    seen = F.when(~F.isnan("price"), F.col("price"))  # a NaN must not hide the highest price
    used = ticks.where(F.col("sec") <= session.close_sec).select(*KEYS, "sec", "tick_id", "price")
    return used.repartition(*KEYS).groupBy(*KEYS, "sec").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.when(~F.max(F.col("tick_id").isNull()), F.min_by("price", "tick_id")).alias("first"), F.max(F.isnan("price")).alias("odd"), F.max(F.col("price").isNull().cast("int")).alias("bare"))


def _meet(trades: DataFrame, seconds: DataFrame, found: Callable[[pa.Table, pa.Table], np.ndarray], session: SessionSpec) -> DataFrame:
    """``trades`` with ``_until`` = ``found``(trades, seconds) of their ticker-day, the session's end where it has no seconds."""
    def run(own: pa.Table, day: pa.Table) -> pa.Table:
        until = found(own, day.sort_by("sec")) if own.num_rows and day.num_rows else np.full(own.num_rows, session.close_sec)
        return own.append_column("_until", pa.array(until.astype("int32"), pa.int32()))

    return trades.groupBy(*KEYS).cogroup(seconds.groupBy(*KEYS)).applyInArrow(run, trades.withColumn("_until", F.lit(0)).schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()  # nulls are NaN


def _buys(own: pa.Table) -> np.ndarray:
    return np.array([s == "buy" for s in own.column("side").to_pylist()])


def last_second(trades: DataFrame, ticks: DataFrame, session: SessionSpec, chains: Chains, shared: bool = False) -> DataFrame:
    """``trades`` with ``_until``: no tick after that second is needed by an operator that is through with a trade once a chain of hits has ended.

    A ticker-day meets its trades in one task, as a row per second of the session at most. With ``shared`` the rows of one trade_id have the latest
    of their ends: for operators to which the later rows of one of them matter when another one's chain has ended.
    """
    since = sorted({h.since for chain in chains for h in chain if h.since})

    def found(own: pa.Table, rows: pa.Table) -> np.ndarray:
        day = Day(*(_numbers(rows, c) for c in ("sec", "lo", "hi", "bare")))
        ends = day.ends(_numbers(own, "entry_sec"), _numbers(own, "entry_price"), _buys(own), {c: _numbers(own, c) for c in since}, chains)
        return np.append(day.sec, session.close_sec)[ends]

    cut = _meet(trades, per_second(ticks, session).drop("first", "odd"), found, session)
    return cut.withColumn("_until", F.max("_until").over(Window.partitionBy("trade_id"))) if shared else cut


def target_second(trades: DataFrame, ticks: DataFrame, session: SessionSpec, target: float) -> DataFrame:
    """``last_second`` for one target on returns that count from the first tick's price. A trade whose day can't reach it needs its first tick only.

    A trade_id that comes more than once has several first ticks, of which one counts: its path is left whole.
    """
    def found(own: pa.Table, rows: pa.Table) -> np.ndarray:
        day = Day(*(_numbers(rows, c) for c in ("sec", "lo", "hi", "bare")))
        entry, buy, n = _numbers(own, "entry_sec"), _buys(own), rows.num_rows
        begin = day.at(entry)
        base = np.append(_numbers(rows, "first"), np.nan)[begin]
        ends, perhaps = (day.ends(entry, base, buy, {}, [[Hit(target)]], sure) for sure in (SURE, -SURE))
        nans = np.flatnonzero(rows.column("odd").fill_null(False).to_numpy(zero_copy_only=False))
        hopeless = (perhaps == n) & (base > 0) & np.isfinite(base) & (begin > (nans[-1] if len(nans) else -1))
        return np.append(day.sec, session.close_sec)[np.where(hopeless, begin, ends)]

    cut = _meet(trades, per_second(ticks, session), found, session)
    alone = F.count(F.lit(1)).over(Window.partitionBy("trade_id")) == 1
    return cut.withColumn("_until", F.when(alone, F.col("_until")).otherwise(F.lit(session.close_sec)))
