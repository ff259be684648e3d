"""From fills to round-trip trades, and values that follow trades through the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numbers import pct_of, round_to
from tickloom.operators import blocks, joins, paths
from tickloom.session import stage

KEYS = ["ticker", "trade_date"]
FILL_ORDER = ["sec", "fill_id"]


def position_episodes(fills: DataFrame) -> DataFrame:
    """Adds ``pos`` (signed position after the fill), ``prev`` (before) and ``ep`` (episode number).

    An episode opens on a flat position. Passing through zero without stopping there does not close it.
    """
    pos = blocks.running_sum(fills, KEYS, blocks.time_block(), FILL_ORDER, {"pos": F.col("qty").cast("long")})
    pos = stage(pos.withColumn("prev", F.col("pos") - F.col("qty")))
    starts = F.when(F.col("prev") == 0, 1).otherwise(0).cast("long")
    return blocks.running_sum(pos, KEYS, blocks.time_block(), FILL_ORDER, {"ep": starts})


def round_trips(episodes: DataFrame) -> DataFrame:
    """One row per closed episode, from one aggregate (fills combine map-side).

    Profit of the later fills is sum(sign * |q| * p) - p_entry * sum(sign * |q|), where sign is the
    side of the position before the fill; so the entry price is not needed row by row.
    """
    order = F.struct(*FILL_ORDER)
    later = F.col("prev") != 0
    weight = F.signum(F.col("prev").cast("double")) * F.abs("qty")
    g = episodes.groupBy(*KEYS, "ep").agg(
        F.min_by("fill_id", order).alias("trade_id"),
        F.min("sec").alias("entry_sec"),
        F.max("sec").alias("exit_sec"),
        F.min_by("net_price", order).alias("_p0"),
        F.max_by("net_price", order).alias("_p1"),
        F.min_by("qty", order).alias("_q0"),
        F.max_by("pos", order).alias("_last"),
        F.sum(F.when(later, weight * F.col("net_price")).otherwise(0.0)).alias("_a"),
        F.sum(F.when(later, weight).otherwise(0.0)).alias("_b"),
        F.count(F.lit(1)).alias("fills"),
    )
    dollars = round_to(F.col("_a") - F.col("_p0") * F.col("_b"), 8)
    invested = F.abs(F.col("_q0") * F.col("_p0"))
    return g.where("_last = 0").select(
        *KEYS, "ep", "trade_id", "entry_sec", "exit_sec",
        (F.col("exit_sec") - F.col("entry_sec")).alias("duration_sec"),
        round_to("_p0", 4).alias("entry_price"), round_to("_p1", 4).alias("exit_price"),
        F.when(F.col("_q0") > 0, "buy").otherwise("short").alias("side"),
        F.abs("_q0").cast("int").alias("qty"),
        round_to(dollars, 2).alias("dollar_change"),
        round_to(invested, 2).alias("investment"),
        pct_of(dollars, invested).alias("pct_change"),
        "fills",
    )


def trade_pnl(episodes: DataFrame) -> DataFrame:
    """E2."""
    return round_trips(episodes).select(*KEYS, "ep", "trade_id", "investment", "dollar_change", "pct_change")


def trade_times(episodes: DataFrame) -> DataFrame:
    """E3."""
    return round_trips(episodes).select(
        *KEYS, "ep", "trade_id", "entry_sec", "exit_sec", "duration_sec", "entry_price", "exit_price", "side", "qty"
    )


def day_block(sec: Column | str = "entry_sec") -> Column:
    """Half-hour number since the epoch, for orders over whole histories."""
    sec = F.col(sec) if isinstance(sec, str) else sec
    return F.unix_date("trade_date").cast("long") * 48 + F.floor(sec / blocks.HALF_HOUR)


def dense_trade_id(trades: DataFrame, name: str = "trade_no") -> DataFrame:
    """1..n by date and entry time. Only one count per range of the order crosses tasks."""
    order = ["trade_date", "entry_sec", "trade_id"]
    return blocks.row_numbers(blocks.in_ranges(trades, order), [], F.col("_range"), order, name).drop("_range")


ENTRY_COLS = ("sec", "tick_id", "price", "atr14", "atr28", "adx28", "adx14", "adx7", "rsi")


def entry_conditions(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """E5: indicator values at the first tick at or after entry; null where there is none."""
    j = joins.asof_forward(trades, ticks, "entry_sec", ENTRY_COLS)
    return j.select(
        *trades.columns,
        F.col("tick.sec").alias("first_tick_sec"),
        F.col("tick.atr14").alias("entry_atr14"), F.col("tick.atr28").alias("entry_atr28"),
        pct_of(F.col("tick.atr14"), F.col("tick.price")).alias("entry_vol"),
        round_to(F.try_divide(F.col("tick.atr14"), F.col("tick.atr28"))).alias("entry_ratio"),
        F.col("tick.adx28").alias("entry_adx28"), F.col("tick.adx14").alias("entry_adx14"),
        F.col("tick.adx7").alias("entry_adx7"), F.col("tick.rsi").alias("entry_rsi"),
    )


def running_percents(trades: DataFrame, pct: str = "pct_change") -> DataFrame:
    """running sums of the rounded percents within a day, by ticker and over all trades."""
    order, block = ["entry_sec", "trade_id"], F.col("_range")
    ranged = blocks.in_ranges(trades, ["trade_date", *order])
    by_ticker = blocks.running_sum(ranged, ["trade_date", "ticker"], block, order, {"running_by_ticker": F.col(pct)})
    both = blocks.running_sum(by_ticker, ["trade_date"], block, order, {"running_all": F.col(pct)}).drop("_range")
    for c in ("running_by_ticker", "running_all"):
        both = both.withColumn(c, round_to(round_to(c, 6), 2))
    return both


def build_trade_summary(fills: DataFrame, ticks: DataFrame) -> DataFrame:
    """The full trade summary; tick-derived columns stay null where no tick follows the entry."""
    trips = stage(running_percents(stage(round_trips(position_episodes(fills)))))
    with_entry = entry_conditions(trips, ticks)
    exc = paths.excursions(trips, ticks).select(
        "trade_id", "best_price", "best_pct", "best_sec_in_trade", "worst_price", "worst_pct", "worst_sec_in_trade", "holding_reached"
    )
    numbers = dense_trade_id(trips.select("trade_id", "trade_date", "entry_sec")).select("trade_id", "trade_no")
    return with_entry.join(exc, "trade_id", "left").join(numbers, "trade_id")


def recent_trade_context(trades: DataFrame, pct: str = "pct_change", min_sec: int = 240) -> DataFrame:
    """mean percent of the previous two trades on the ticker, and whether the previous one lasted.

    The history of a ticker is cut into half hours. The last two trades of a half hour are its summary;
    the two non-empty half hours before a block hold at least two trades, if that many exist.
    """
    keys = ["ticker", "_blk"]
    order = F.struct("entry_sec", "trade_id")
    item = F.struct(F.col(pct).alias("pct"), F.col("duration_sec").alias("dur"))
    cut = trades.withColumn("_blk", day_block())
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("entry_sec"), F.desc("trade_id"))
    last_two = cut.withColumn("_rn", F.row_number().over(newest_first)).where("_rn <= 2")
    ends = last_two.groupBy(*keys).agg(
        F.max_by(item, order).alias("_l1"), F.max(F.when(F.col("_rn") == 2, item)).alias("_l2")
    )
    w_blocks = Window.partitionBy("ticker").orderBy("_blk")
    before = (
        ends.withColumn("_p1", F.lag("_l1").over(w_blocks))
        .withColumn("_p2", F.coalesce(F.lag("_l2").over(w_blocks), F.lag("_l1", 2).over(w_blocks)))
        .select(*keys, "_p1", "_p2")
    )
    w = Window.partitionBy(*keys).orderBy("entry_sec", "trade_id")
    rows = cut.withColumn("_d1", F.lag(item, 1).over(w)).withColumn("_d2", F.lag(item, 2).over(w)).join(before, keys)
    one = F.coalesce("_d1", "_p1")
    two = F.when(F.col("_d1").isNull(), F.col("_p2")).otherwise(F.coalesce("_d2", "_p1"))
    total = F.coalesce(one["pct"], F.lit(0.0)) + F.coalesce(two["pct"], F.lit(0.0))
    n = one.isNotNull().cast("int") + two.isNotNull().cast("int")
    return rows.select(
        *trades.columns,
        round_to(F.try_divide(total, n), 6).alias("avg_last_2"),
        (one["dur"] >= min_sec).alias("prev_lasted"),
    )


def day_pnl_steps(path: DataFrame) -> DataFrame:
    """Change of the day's total return per second: sum over trades of roi - previous roi of the trade."""
    w = Window.partitionBy("trade_id").orderBy("sec", "tick_id")
    step = F.col("roi") - F.coalesce(F.lag("roi").over(w), F.lit(0.0))
    return path.withColumn("_step", step).groupBy("trade_date", "sec").agg(round_to(F.sum("_step"), 6).alias("step"))


def day_pnl_curve(path: DataFrame) -> DataFrame:
    """per second the total return of the day. At most one row per second of a day is ordered."""
    w = Window.partitionBy("trade_date").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    return day_pnl_steps(path).select("trade_date", "sec", round_to(F.sum("step").over(w), 4).alias("day_roi"))


def day_pnl_extremes(path: DataFrame) -> DataFrame:
    """final and highest total return of a day (highest is at least 0)."""
    return day_pnl_curve(path).groupBy("trade_date").agg(
        F.max_by("day_roi", "sec").alias("final_roi"), F.greatest(F.max("day_roi"), F.lit(0.0)).alias("highest_roi")
    )


def minute_bar_vol(ticks: DataFrame, minutes: int = 10, blend: float = 10.0) -> DataFrame:
    """F16: early-session volatility estimate from minute moves, blended with ATR.

    A closed minute contributes |last price before - first price| / first price of the minute that
    follows it; the current minute contributes the move since its first price. The mean of the last two
    closed minutes and the current one, in price units, is weighted against ATR by minutes / blend.
    """
    k = ["ticker", "trade_date"]
    order = F.struct("sec", "tick_id")
    minute = F.floor(F.col("sec") / 60).cast("int")
    bars = ticks.groupBy(*k, minute.alias("_m")).agg(
        F.min_by("price", order).alias("_open"), F.max_by("price", order).alias("_close")
    )
    w = Window.partitionBy(*k).orderBy("_m")
    move = F.abs((F.lag("_close").over(w) - F.col("_open")) / F.col("_open"))
    bars = (
        bars.withColumn("_move1", move).withColumn("_move2", F.lag("_move1").over(w))
        .withColumn("_age", F.col("_m") - F.min("_m").over(Window.partitionBy(*k)))
        .where(F.col("_age") < minutes)
    )
    rows = ticks.withColumn("_m", minute).join(bars, [*k, "_m"])
    now = F.abs((F.col("price") - F.col("_open")) / F.col("_open"))
    n = F.lit(1) + F.col("_move1").isNotNull().cast("int") + F.col("_move2").isNotNull().cast("int")
    mean = (F.coalesce("_move2", F.lit(0.0)) + F.coalesce("_move1", F.lit(0.0)) + now) / n
    share = F.least(F.col("_age") / F.lit(blend), F.lit(1.0))
    share = F.when(share == 0, F.lit(1.0 / blend)).otherwise(share)
    atr = share * F.col("atr14") + (F.lit(1.0) - share) * mean * F.col("price")
    vol = F.when((F.col("_age") == 0) & (atr == 0), F.lit(None).cast("double")).otherwise(round_to(atr / F.col("price") * 100.0))
    return rows.select(*ticks.columns, F.col("_age").alias("minute_no"), vol.alias("vol_estimate"))
