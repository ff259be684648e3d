"""Joins between trades and ticks.

All of them carry the equality keys (ticker, trade_date). Interval joins add a time-bucket key, so a
busy ticker-day is spread over many tasks; nearest-tick joins sort the union of both sides inside time
blocks instead of pairing rows. Open intervals, which keep half of all pairs, are an equi-join with a condition. No side is hinted for broadcast: Spark broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and never one that an interval join has repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators import blocks
from tickloom.session import MARKET_HOURS, SessionSpec, stage

KEYS = ["ticker", "trade_date"]
#: bucket of joins whose intervals are short
FIVE_MINUTES = 300


#: hot keys at most by each of two counts, and so half the rows of the only table that is ever broadcast
HOT_KEYS = 1000
#: joined rows that a task should make at most, and tasks of a join at most
PAIRS, TASKS = 20_000_000, 10_000


def hot_keys(trades: DataFrame, ticks: DataFrame, keys: Sequence[str], most: int, pairs: int = PAIRS) -> tuple[DataFrame, int]:
    """(keys, _parts) of the keys with more than ``most`` ticks or more than ``pairs`` joined rows, and the joined rows of all keys.

    Both limits are a ``HOT_KEYS``-th of all where that is larger; so there are fewer than twice ``HOT_KEYS``.
    """
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    counts = stage(n(ticks, "_n").join(n(trades, "_t"), list(keys)).withColumn("_p", F.col("_n") * F.col("_t").cast("double")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_p"), F.lit(0.0)).alias("p")).first()
    size, made = max(most, total["n"] // HOT_KEYS), max(pairs, total["p"] / HOT_KEYS)
    parts = F.greatest(F.ceil(F.col("_n") / size), F.ceil(F.col("_p") / made)).cast("int")
    return counts.select(*keys, parts.alias("_parts")).where("_parts > 1"), int(total["p"])


def equi_join(trades: DataFrame, ticks: DataFrame, most: int = 1_000_000, pairs: int = PAIRS) -> DataFrame:
    """Every tick of the trade's ticker and day.

    Ticks and trades are counted per key first. The ticks of a key with more than ``most`` rows, or more than ``pairs`` rows in the result, are dealt to
    several parts by hash, and its trades are repeated for each part; all other keys meet as they are. Spark chooses its number of tasks by the size
    of what is read; where the result is much larger, both sides are dealt to as many tasks as its rows need.
    """
    hot, total = hot_keys(trades, ticks.where(F.col("ticker").isNotNull() & F.col("trade_date").isNotNull()), KEYS, most, pairs)
    tasks = min(TASKS, -(-total // pairs))
    on, out = KEYS, (trades, ticks)
    if not hot.isEmpty():
        hot = F.broadcast(hot)  # fewer than 2 * HOT_KEYS rows
        parts = F.coalesce("_parts", F.lit(1))
        dealt = ticks.join(hot, KEYS, "left").withColumn("_part", F.pmod(F.xxhash64("sec", "tick_id"), parts).cast("int")).drop("_parts")
        spread = trades.join(hot, KEYS, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        on, out = [*KEYS, "_part"], (spread, dealt)
    if tasks > 1:
        tasks = max(tasks, int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        out = tuple(x.repartition(tasks, *on) for x in out)
    return out[0].join(out[1], on).drop("_part")


def nearest_tick(trades: DataFrame, ticks: DataFrame, at: str, cols: Sequence[str], forward: bool) -> DataFrame:
    """First tick with sec >= ``at`` (forward) or last tick with sec <= ``at``.

    Adds ``tick`` (struct of ``cols``), null where no such tick exists. Ties on a second resolve by
    tick_id: lowest forward, highest backward.
    """
    probe = trades.select(*KEYS, F.col(at).alias("sec"), F.struct(*trades.columns).alias("_trade"))
    probe = probe.withColumn("_kind", F.lit(0 if forward else 1)).withColumn("_id", F.lit(None).cast("long"))
    side = ticks.select(
        *KEYS, "sec", F.col("tick_id").cast("long").alias("_id"), F.struct(*cols).alias("tick")
    ).withColumn("_kind", F.lit(1 if forward else 0))
    rows = probe.unionByName(side, allowMissingColumns=True)
    found = blocks.carry_value(
        rows, KEYS, blocks.time_block(), ["sec", "_kind", "_id"], F.col("tick"), "found", forward=forward
    )
    return found.where(F.col("_trade").isNotNull()).select("_trade.*", F.col("found").alias("tick"))


def asof_forward(trades: DataFrame, ticks: DataFrame, at: str = "entry_sec", cols: Sequence[str] = ("sec", "tick_id", "price")) -> DataFrame:
    return nearest_tick(trades, ticks, at, cols, forward=True)


def asof_backward(trades: DataFrame, ticks: DataFrame, at: str = "exit_sec", cols: Sequence[str] = ("sec", "tick_id", "price")) -> DataFrame:
    return nearest_tick(trades, ticks, at, cols, forward=False)


def interval_join(trades: DataFrame, ticks: DataFrame, start: Column, end: Column, width: int = blocks.HALF_HOUR) -> DataFrame:
    """Ticks with start <= sec <= end.

    Each trade is repeated once per time bucket it touches, each tick lies in one bucket, so every
    pair is produced once. Spark's size check sees the trades before they are repeated, so it would send
    a table many times the threshold through the driver: the join asks for a merge instead.
    """
    spread = trades.withColumn("_s", start).withColumn("_e", end).where("_s <= _e").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width)))
    )
    bucketed = ticks.withColumn("_b", F.floor(F.col("sec") / width))
    return spread.hint("merge").join(bucketed, [*KEYS, "_b"]).where(F.col("sec").between(F.col("_s"), F.col("_e"))).drop("_b", "_s", "_e")


def open_interval_join(trades: DataFrame, ticks: DataFrame, start: Column, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """Ticks from ``start`` to the end of the session.

    About half of all pairs of a ticker-day stay, so nothing is repeated per bucket: it is ``equi_join`` with a condition. Of a stream nothing can be counted
    first, so trades and ticks meet in buckets.
    """
    if trades.isStreaming or ticks.isStreaming:
        return interval_join(trades, ticks, start, F.lit(session.close_sec))
    begun = trades.withColumn("_s", start).where(F.col("_s") <= session.close_sec)
    return equi_join(begun.hint("merge"), ticks.where(F.col("sec") <= session.close_sec)).where(F.col("sec") >= F.col("_s")).drop("_s")


def prefix_entry(entries: DataFrame, ticks: DataFrame) -> DataFrame:
    """Entries (ticker, trade_date, entry_minute) -> first tick inside that clock minute.

    Ticks are reduced to one row per minute before the join.
    """
    firsts = ticks.groupBy(*KEYS, F.floor(F.col("sec") / 60).cast("int").alias("entry_minute")).agg(
        F.min(F.struct("sec", "tick_id", "price")).alias("_f")
    )
    return entries.join(firsts, [*KEYS, "entry_minute"]).select(
        *entries.columns, F.col("_f.sec").alias("entry_sec"), F.col("_f.tick_id").alias("entry_tick_id"), F.col("_f.price").alias("entry_price")
    )


def keep_matching(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D7."""
    return left.join(right, list(keys), "left_semi")


def keep_absent(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D8."""
    return left.join(right, list(keys), "left_anti")


def satisfied_levels(value: Column, levels: Sequence[float]) -> Column:
    """The levels a row passes (value >= level), as an array.

    Exploding it equals the theta join with the level list, without pairing rows and levels.
    """
    return F.filter(F.array(*[F.lit(x) for x in levels]), lambda level: value >= level)


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the band with edges[i] <= value < edges[i+1], null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((value >= F.lit(edges[i])) & (value < F.lit(edges[i + 1])), F.lit(i)).otherwise(out)
    return out


def parameter_grid(spark, **lists: Sequence) -> DataFrame:
    """Every combination of the given values, one column per name.

    Combinations are decoded from a distributed range by mixed-radix digits; nothing is joined.
    """
    total = 1
    for values in lists.values():
        total *= len(values)
    grid = spark.range(total)
    cols, step = [], total
    for name, values in lists.items():
        step //= len(values)
        digit = F.pmod(F.floor(F.col("id") / F.lit(step)), F.lit(len(values))).cast("int")
        cols.append(F.element_at(F.array(*[F.lit(v) for v in values]), digit + 1).alias(name))
    return grid.select(F.col("id").alias("combo_id"), *cols)


def tick_bounds(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """First tick at or after entry and last tick at or before exit, with ``valid``."""
    cols = ("sec", "tick_id", "price")
    trade = F.struct(*trades.columns).alias("_trade")
    # both probes of every trade and all ticks in one order: entry probes before the ticks of their second, exit probes after them
    sides = [trades.select(*KEYS, F.col(at).alias("sec"), F.lit(kind).alias("_kind"), F.lit(None).cast("long").alias("_id"), trade) for at, kind in (("entry_sec", 0), ("exit_sec", 2))]
    side = ticks.select(*KEYS, "sec", F.lit(1).alias("_kind"), F.col("tick_id").cast("long").alias("_id"), F.struct(*cols).alias("tick"))
    rows = sides[0].unionByName(sides[1]).unionByName(side, allowMissingColumns=True)
    found = blocks.carry_both(rows, KEYS, blocks.time_block(), ["sec", "_kind", "_id"], F.col("tick"), "_back", "_ahead").where(F.col("_trade").isNotNull())
    # a trade's two probes meet again by the trade's own columns
    ends = found.groupBy("_trade").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_ahead"))).alias("start_tick"), F.max(F.when(F.col("_kind") == 2, F.col("_back"))).alias("end_tick"), F.count(F.when(F.col("_kind") == 0, 1)).alias("_times"))
    both = ends.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_trade.*", "start_tick", "end_tick")
    order = lambda c: F.struct(F.col(f"{c}.sec"), F.col(f"{c}.tick_id"))
    ok = F.col("start_tick").isNotNull() & F.col("end_tick").isNotNull() & (order("start_tick") <= order("end_tick"))
    return both.withColumn("valid", F.coalesce(ok, F.lit(False)))


def valid_pairs(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    return tick_bounds(trades, ticks).where("valid").drop("valid")
