"""Return paths of trades: long tables with one row per (trade, tick).

Rows of one trade are at most the ticks of one session of one ticker (ticks are unique per ticker and
second, see sources.tables.insert_absent), so windows partitioned by trade stay small. Operators that
only need extremes or first hits are aggregates, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.clock import minutes_since_open
from tickloom.functions.numbers import pct_of, roi, round_to, signed_change
from tickloom.operators import blocks, ends, joins
from tickloom.operators.ends import Chains, Hit
from tickloom.session import MARKET_HOURS, SessionSpec

TRADE_COLS = ["trade_id", "ticker", "trade_date", "side", "entry_sec", "exit_sec", "entry_price"]


def _w():
    return Window.partitionBy("trade_id").orderBy("sec", "tick_id")


def _before():
    return _w().rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def _ahead():
    """This row and all later ones, written as a growing frame in reverse order (evaluated incrementally)."""
    return Window.partitionBy("trade_id").orderBy(F.desc("sec"), F.desc("tick_id")).rowsBetween(Window.unboundedPreceding, 0)


def _at():
    return F.struct("sec", "tick_id")


def _sides(trades: DataFrame, ticks: DataFrame, extra: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return trades.select(*TRADE_COLS), ticks.select("ticker", "trade_date", "sec", "tick_id", "price", *extra)


def roi_path(trades: DataFrame, ticks: DataFrame, session: SessionSpec = MARKET_HOURS, extra: Sequence[str] = (), over: Chains | None = None, shared: bool = False) -> DataFrame:
    """return per tick from entry to the end of the session (rounded, and unrounded as raw_roi).

    For operators that drop all rows after some first hits, or need none of them: ``over`` has the chains of hits after which they are through
    with a trade. The path then ends with the second in which the first chain has ended for sure, which is known before trades meet ticks (``shared``: see ``ends.last_second``).
    """
    t, k = _sides(trades, ticks, extra)
    return _with_returns(joins.open_interval_join(t, k, F.col("entry_sec"), session) if over is None else _path_until(ends.last_second(t, k, session, over, shared), k))


def _path_until(t: DataFrame, k: DataFrame) -> DataFrame:
    return joins.interval_join(t, k, F.col("entry_sec"), F.col("_until"), joins.FIVE_MINUTES).drop("_until")


def _with_returns(path: DataFrame) -> DataFrame:
    entry, price, side = F.col("entry_price"), F.col("price"), F.col("side")
    return path.withColumn("raw_roi", signed_change(entry, price, side)).withColumn("roi", round_to("raw_roi", 2))


def trade_path(trades: DataFrame, ticks: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The same from entry to exit."""
    t, k = _sides(trades, ticks, extra)
    return _with_returns(joins.interval_join(t, k, F.col("entry_sec"), F.col("exit_sec")))


def excursions(trades: DataFrame, ticks: DataFrame, holding: float = 0.6) -> DataFrame:
    """best and worst price inside [entry, exit] and when each was first reached.

    The entry price itself is the starting value; time is 0 when it was never improved. All null where
    the ticker has no tick at or after the entry.
    """
    t, k = _sides(trades, ticks, ())
    last = k.groupBy("ticker", "trade_date").agg(F.max("sec").alias("_last"))
    gain = F.col("raw_roi")
    seen = trade_path(trades, ticks).groupBy("trade_id").agg(
        F.min("sec").alias("_first"),
        F.max_by(F.struct("price", "sec"), F.when(gain > 0, F.struct(gain, -F.col("sec"), -F.col("tick_id")))).alias("_best"),
        F.max_by(F.struct("price", "sec"), F.when(gain < 0, F.struct(-gain, -F.col("sec"), -F.col("tick_id")))).alias("_worst"),
    )
    known = F.col("_last") >= F.col("entry_sec")
    j = t.join(last, ["ticker", "trade_date"], "left").join(seen, "trade_id", "left")
    entry, side = F.col("entry_price"), F.col("side")

    def value(name: str) -> tuple[Column, Column, Column]:
        price = F.coalesce(F.col(f"{name}.price"), entry)
        return (
            F.when(known, round_to(price, 4)),
            F.when(known, roi(entry, price, side)),
            F.when(known, F.coalesce(F.col(f"{name}.sec") - F.col("_first"), F.lit(0)).cast("int")),
        )

    bp, bpct, bt = value("_best")
    wp, wpct, wt = value("_worst")
    out = j.select(
        *TRADE_COLS, bp.alias("best_price"), bpct.alias("best_pct"), bt.alias("best_sec_in_trade"),
        wp.alias("worst_price"), wpct.alias("worst_pct"), wt.alias("worst_sec_in_trade"),
    )
    return out.withColumn("holding_reached", F.col("best_pct") >= holding)


def at_stop(sl: float = -0.4, hold: float = 0.6, hold_sl: float = 0.0) -> Chains:
    """``over`` of ``roi_path`` for F4's path, and with the highest holding value for G5: a return of ``sl`` or less ends it in any state, one of ``hold_sl`` or
    less once ``hold`` was reached."""
    return [[Hit(sl, up=False)], [Hit(hold), Hit(hold_sl, up=False)]]


def stop_state_path(path: DataFrame, hold: float = 0.6, hold_sl: float = 0.0, sl: float = -0.4) -> DataFrame:
    """rows up to and including the stop.

    The stop is the first row with roi <= sl, or with roi <= hold_sl after an earlier row had
    roi >= hold. ``armed`` and ``stopped`` describe the row.
    """
    armed = F.coalesce(F.max((F.col("roi") >= hold).cast("int")).over(_before()), F.lit(0))
    hit = ((F.col("roi") <= sl) | ((F.col("armed") == 1) & (F.col("roi") <= hold_sl))).cast("int")
    marked = path.withColumn("armed", armed).withColumn("stopped", hit)
    return (
        marked.withColumn("_dead", F.coalesce(F.max("stopped").over(_before()), F.lit(0)))
        .where("_dead = 0").drop("_dead")
    )


def best_future_roi(path: DataFrame) -> DataFrame:
    """F5."""
    return path.withColumn("best_future", F.max("roi").over(_ahead()))


def sample_every(path: DataFrame, minutes: int = 10, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """the first row of the path and of each later step of ``minutes`` since entry."""
    m = minutes_since_open(F.col("sec"), session)
    numbered = path.withColumn("minutes", m).withColumn(
        "step", F.floor((F.col("minutes") - F.first("minutes").over(_so_far())) / minutes).cast("int")
    )
    w = Window.partitionBy("trade_id", "step").orderBy("sec", "tick_id")
    return numbered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def price_ladder(path: DataFrame, anchors: Sequence[int] = ()) -> DataFrame:
    """visited 0.1 percent rungs (integer tenths) with every skipped rung filled in.

    The level of a tick is its return truncated toward zero. ``pos`` counts rungs from 1. For each of ``anchors`` a column ``at_<anchor>`` has
    the anchor's first position where it lies before ``pos``; it comes from the ticks' order, so the many more rungs are not sorted.
    """
    level = (F.col("raw_roi") * 10).cast("int")
    steps = path.withColumn("_lvl", level).withColumn("_prev", F.lag("_lvl").over(_w()))
    one = F.array("_lvl")
    up = F.when(F.col("_lvl") > F.col("_prev"), F.lit(1)).otherwise(F.lit(-1))
    rungs = (
        F.when(F.col("_prev").isNull(), one)
        .when(F.col("_prev") == F.col("_lvl"), F.expr("cast(array() as array<int>)"))
        .otherwise(F.sequence(F.col("_prev") + up, F.col("_lvl"), up))
    )
    moved = steps.withColumn("_r", rungs).where(F.size("_r") > 0)
    base = F.coalesce(F.sum(F.size("_r")).over(_before()), F.lit(0)).cast("int")
    met = {a: F.array_position("_r", F.lit(a)).cast("int") for a in anchors}
    seen = {f"at_{a}": F.min(F.when(m > 0, F.col("_base") + m)).over(_so_far()) for a, m in met.items()}
    pos = (F.col("_base") + F.col("_i") + 1).cast("int")
    return (
        moved.withColumn("_base", base).withColumns(seen)
        .select("trade_id", "_base", *seen, F.posexplode("_r").alias("_i", "rung"))
        .select("trade_id", pos.alias("pos"), "rung", *[F.when(F.col(c) < pos, F.col(c)).alias(c) for c in seen])
    )


def ladder_text(ladder: DataFrame) -> DataFrame:
    """The ladder as the 'a|b|c' text of the summary files; one session bounds its length."""
    item = F.struct("pos", "rung")
    return ladder.groupBy("trade_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: F.format_string("%.1f", x["rung"] / F.lit(10.0))), "|"
        ).alias("ladder")
    )


def first_hits(ladder: DataFrame) -> DataFrame:
    """F8: first position of every rung, all levels in one aggregate."""
    return ladder.groupBy("trade_id", "rung").agg(F.min("pos").alias("pos"))


def first_cross(path: DataFrame, up: Sequence[float] = (), down: Sequence[float] = ()) -> DataFrame:
    """F8 on returns: per trade the first row with roi >= level, or <= level, one column per level."""
    aggs = [F.min(F.when(F.col("roi") >= x, _at())).alias(f"up_{i}") for i, x in enumerate(up)]
    aggs += [F.min(F.when(F.col("roi") <= x, _at())).alias(f"down_{i}") for i, x in enumerate(down)]
    return path.groupBy("trade_id").agg(*aggs)


def first_hits_after(ladder: DataFrame, anchors: Sequence[int]) -> DataFrame:
    """for each anchor rung, the first position of every rung strictly after the anchor's first hit."""
    whole = Window.partitionBy("trade_id")
    starts = F.array(*[F.struct(F.lit(a).alias("anchor"), F.min(F.when(F.col("rung") == a, F.col("pos"))).over(whole).alias("at")) for a in anchors])
    return (
        ladder.withColumn("_s", starts)
        .select("trade_id", "pos", "rung", F.explode(F.filter("_s", lambda s: s["at"] < F.col("pos"))).alias("_a"))
        .groupBy("trade_id", F.col("_a.anchor").alias("anchor"), "rung")
        .agg(F.min("pos").alias("pos"))
    )


def best_stop_loss(trades: DataFrame, ticks: DataFrame, target: float = 0.6, margin: float = 0.1, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """worst return before the target is first reached, minus a margin; null if never reached.

    Returns count from the first tick's price, not from the fill price.
    """
    t, k = _sides(trades, ticks, ())
    path = _path_until(ends.target_second(t, k, session, target), k)
    r = signed_change(F.first("price").over(_so_far()), F.col("price"), F.col("side"))
    rel = path.withColumn("_r", r)
    rel = rel.withColumn("_done", F.coalesce(F.max((F.col("_r") >= target).cast("int")).over(_before()), F.lit(0))).where("_done = 0")
    g = rel.groupBy("trade_id").agg(F.max("_r").alias("_hi"), F.least(F.min("_r"), F.lit(0.0)).alias("_lo"))
    return g.select("trade_id", F.when(F.col("_hi") >= target, round_to(F.col("_lo") - margin)).alias("best_sl"))


def _hold_flags(path: DataFrame, holding: float) -> DataFrame:
    entry, price = F.col("entry_price"), F.col("price")
    back = F.when(F.col("side") == "buy", price <= entry).otherwise(price >= entry)
    flagged = path.withColumn("reached", F.max(F.col("raw_roi") >= holding).over(_so_far()))
    hit = F.col("reached") & (F.col("sec") >= F.col("exit_sec")) & back
    return flagged.withColumn("_hit", hit).withColumn("returned", F.max("_hit").over(_so_far())).drop("_hit")


# fixed values: hours after entry, and percent targets
HORIZON_HOURS = (1.0, 1.5, 2.0, 2.5, 3.0)
TARGET_PERCENTS = (1.0, 2.0, 2.5, 3.0, 3.5, 4.0)


def _came_back(holding: float) -> list[Hit]:
    """The chain of hits after which ``returned`` of ``_hold_flags`` is set."""
    return [Hit(holding), Hit(0.0, up=False, since="exit_sec")]


def horizon_roi(trades: DataFrame, ticks: DataFrame, holding: float = 0.6, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """for holders, the return at the first tick h hours after entry.

    0 once the price came back to the entry, after the holding level and after the exit; the last
    return where the day ends first.
    """
    holders = excursions(trades, ticks, holding).where("holding_reached")
    # through once the price is back, or with the first tick after the last horizon; a first tick without a price has the day's last return instead
    *early, last = sorted(int(h * 3600) for h in HORIZON_HOURS)
    over = [_came_back(holding), [Hit(since="entry_sec", plus=last, also=tuple(early))]]
    path = _hold_flags(roi_path(holders, ticks, session, over=over), holding)
    now = F.when(F.col("returned"), F.lit(0.0)).otherwise(F.col("roi"))
    wait = F.col("sec") - F.col("entry_sec")
    aggs = [F.min_by(now, F.when(wait >= int(h * 3600), _at())).alias(f"h{i}") for i, h in enumerate(HORIZON_HOURS)]
    g = path.groupBy("trade_id").agg(*aggs, F.max_by(now, _at()).alias("_end"))
    names = ["roi_1h", "roi_1_5h", "roi_2h", "roi_2_5h", "roi_3h"]
    return g.select("trade_id", *[F.coalesce(f"h{i}", "_end").alias(n) for i, n in enumerate(names)])


def target_attain(trades: DataFrame, ticks: DataFrame, holding: float = 0.6, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """for holders and each percent target: the target if reached first, 0 if the price came back
    first, else the final return. Counted from the row that reached the holding level."""
    holders = excursions(trades, ticks, holding).where("holding_reached")
    over = [_came_back(holding), [Hit(max(holding, *TARGET_PERCENTS))]]
    path = _hold_flags(roi_path(holders, ticks, session, over=over), holding)
    aggs = []
    for i, p in enumerate(TARGET_PERCENTS):
        decided = F.col("reached") & (F.col("returned") | (F.col("raw_roi") >= p))
        aggs.append(F.min_by(F.when(F.col("returned"), F.lit(0.0)).otherwise(F.lit(p)), F.when(decided, _at())).alias(f"t{i}"))
    g = path.groupBy("trade_id").agg(*aggs, F.max("reached").alias("_any"), F.max_by("roi", _at()).alias("_end"))
    names = ["pct_1", "pct_2", "pct_2_5", "pct_3", "pct_3_5", "pct_4"]
    return g.select("trade_id", *[F.when(F.col("_any"), F.coalesce(f"t{i}", "_end")).alias(n) for i, n in enumerate(names)])


def reevaluated_exit(
    path: DataFrame, target: Callable[[Column, Column], Column], every: int = 5, session: SessionSpec = MARKET_HOURS
) -> DataFrame:
    """every ``every`` minutes in the trade a new target is set from (minutes since open, vol);
    exit at the first row with roi >= the current target, else at the end of the path."""
    m = minutes_since_open(F.col("sec"), session)
    rows = path.withColumn("_m", m).withColumn("_step", F.floor((F.col("_m") - F.first("_m").over(_so_far())) / every))
    fresh = F.coalesce(F.col("_step") != F.lag("_step").over(_w()), F.lit(True))
    rows = rows.withColumn("_new", F.when(fresh, target(F.col("_m"), F.col("vol"))))
    rows = rows.withColumn("_target", F.last("_new", ignorenulls=True).over(_so_far()))
    hit = F.col("roi") >= F.col("_target")
    here = F.struct("sec", "roi")
    g = rows.groupBy("trade_id", "ticker", "trade_date", "entry_sec").agg(
        F.min_by(here, F.when(hit, _at())).alias("_hit"), F.max_by(here, _at()).alias("_end")
    )
    out = F.coalesce("_hit", "_end")
    return g.select(
        "trade_id", "ticker", "trade_date", "entry_sec", out["sec"].alias("exit_sec"), out["roi"].alias("roi"),
        F.when(F.col("_hit").isNotNull(), "roi hit").otherwise("roi not hit").alias("status"),
    )


def rank_within_row(contributions: DataFrame) -> DataFrame:
    """rank features by absolute contribution per sample and class (ties by feature name)."""
    w = Window.partitionBy("sample_id", "class").orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions.withColumn("rank", F.row_number().over(w))


def first_reach_time(ticks: DataFrame, level: float = 0.3) -> DataFrame:
    """first second at which vol >= level per ticker-day, null if never."""
    return ticks.groupBy("ticker", "trade_date").agg(F.min(F.when(F.col("vol") >= level, F.col("sec"))).alias("first_sec"))


def vol_percent(atr: Column, price: Column) -> Column:
    return pct_of(atr, price)


def tick_gap(ticks: DataFrame) -> DataFrame:
    """seconds since the tick before, of any ticker, on the same day. Blocks are ranges of the ticks' own order."""
    order = ["sec", "tick_id"]
    ranged = blocks.in_ranges(ticks, ["trade_date", *order])
    lagged = blocks.carry_value(ranged, ["trade_date"], F.col("_range"), order, F.col("sec"), "_prev", inclusive=False)
    return lagged.withColumn("gap", F.col("sec") - F.col("_prev")).drop("_range", "_prev")
