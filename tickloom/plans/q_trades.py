"""Queries of family E and of the trade-level window operators F1, F13-F16."""

from __future__ import annotations

from tickloom.operators import paths, trades as ops
from tickloom.plans import texts
from tickloom.plans.fixtures import view
from tickloom.plans.registry import query, rint
from tickloom.session import FULL_DAY

TV = ("trades", "ticks")


@query("E1_position_episodes", ("fills",), f"with {texts.EPISODES} select * from epi")
def _(spark, sf):
    return ops.position_episodes(view(spark, sf, "fills"))


@query("E2_trade_pnl", ("fills",), f"with {texts.EPISODES}, {texts.TRIPS} select ticker, trade_date, ep, trade_id, investment, dollar_change, pct_change from trips")
def _(spark, sf):
    return ops.trade_pnl(ops.position_episodes(view(spark, sf, "fills")))


@query("E3_trade_times", ("fills",), f"with {texts.EPISODES}, {texts.TRIPS} select ticker, trade_date, ep, trade_id, entry_sec, exit_sec, duration_sec, entry_price, exit_price, side, qty from trips")
def _(spark, sf):
    return ops.trade_times(ops.position_episodes(view(spark, sf, "fills")))


@query("E4_dense_trade_id", ("wide_trades",), "select trade_id, trade_date, entry_sec, row_number() over (order by trade_date, entry_sec, trade_id) as trade_no from wide_trades")
def _(spark, sf):
    t = view(spark, sf, "wide_trades").select("trade_id", "trade_date", "entry_sec")
    return ops.dense_trade_id(t)


_ENTRY = (
    "ent as (select t.trade_id, k.sec as first_tick_sec, k.atr14 as entry_atr14, k.atr28 as entry_atr28, "
    f"{rint('k.atr14/k.price*100.0D', 2)} as entry_vol, {rint('k.atr14/k.atr28', 2)} as entry_ratio, "
    "k.adx28 as entry_adx28, k.adx14 as entry_adx14, k.adx7 as entry_adx7, k.rsi as entry_rsi "
    "from {src} t left join lateral (select * from ticks k where k.ticker = t.ticker and k.trade_date = t.trade_date and k.sec >= t.entry_sec order by k.sec, k.tick_id limit 1) k on true)"
)


@query("E5_entry_conditions", TV, "with " + _ENTRY.replace("{src}", "trades") + " select * from ent")
def _(spark, sf):
    t = ops.entry_conditions(view(spark, sf, "trades"), view(spark, sf, "ticks"))
    return t.select("trade_id", "first_tick_sec", *[c for c in t.columns if c.startswith("entry_") and c not in ("entry_sec", "entry_price")])


_RUNNING = (
    "running as (select *, " + rint(rint("sum(pct_change) over (partition by trade_date, ticker order by entry_sec, trade_id)", 6), 2) + " as running_by_ticker, "
    + rint(rint("sum(pct_change) over (partition by trade_date order by entry_sec, trade_id)", 6), 2) + " as running_all from {src})"
)


@query("E6_build_trade_summary", ("fills", "trades", "ticks"), (
    f"with {texts.EPISODES}, {texts.TRIPS}, {texts.TPATH}, {texts.EXCURSIONS}, " + _RUNNING.replace("{src}", "trips") + ", " + _ENTRY.replace("{src}", "trips")
    + " select r.*, e.* exclude (trade_id), x.best_price, x.best_pct, x.best_sec_in_trade, x.worst_price, x.worst_pct, x.worst_sec_in_trade, x.best_pct >= 0.6D as holding_reached, "
    "row_number() over (order by r.trade_date, r.entry_sec, r.trade_id) as trade_no from running r join ent e on e.trade_id = r.trade_id left join exc x on x.trade_id = r.trade_id"
))
def _(spark, sf):
    return ops.build_trade_summary(view(spark, sf, "fills"), view(spark, sf, "ticks"))


@query("F1_running_percents", ("wide_trades",), "with " + _RUNNING.replace("{src}", "wide_trades") + " select trade_id, ticker, trade_date, running_by_ticker, running_all from running")
def _(spark, sf):
    t = view(spark, sf, "wide_trades").select("trade_id", "ticker", "trade_date", "entry_sec", "pct_change")
    return ops.running_percents(t).select("trade_id", "ticker", "trade_date", "running_by_ticker", "running_all")


def _stopped(spark, sf, extra=()):
    path = paths.roi_path(view(spark, sf, "trades"), view(spark, sf, "ticks"), FULL_DAY, extra, paths.at_stop())
    return paths.stop_state_path(path)


DAY_CURVE = (
    f"{texts.PATH}, {texts.stop_path()}, steps as (select trade_date, sec, {rint('sum(step)', 6)} as step from "
    f"(select *, roi - coalesce(lag(roi) over ({texts.W}), 0.0D) as step from spath) q group by trade_date, sec), "
    f"curve as (select trade_date, sec, {rint('sum(step) over (partition by trade_date order by sec)', 4)} as day_roi from steps)"
)


@query("F13_day_pnl_curve", TV, f"with {DAY_CURVE} select * from curve")
def _(spark, sf):
    return ops.day_pnl_curve(_stopped(spark, sf))


@query("F14_day_pnl_extremes", TV, f"with {DAY_CURVE} select trade_date, max_by(day_roi, sec) as final_roi, greatest(max(day_roi), 0.0D) as highest_roi from curve group by trade_date")
def _(spark, sf):
    return ops.day_pnl_extremes(_stopped(spark, sf))


@query("F15_recent_trade_context", ("wide_trades",), f"""
select trade_id, {rint('avg(pct_change) over (w rows between 2 preceding and 1 preceding)', 6)} as avg_last_2,
  lag(duration_sec) over w >= 240 as prev_lasted
from wide_trades window w as (partition by ticker order by trade_date, entry_sec, trade_id)""")
def _(spark, sf):
    t = view(spark, sf, "wide_trades").select("trade_id", "ticker", "trade_date", "entry_sec", "duration_sec", "pct_change")
    return ops.recent_trade_context(t).select("trade_id", "avg_last_2", "prev_lasted")


@query("F16_minute_bar_vol", ("ticks",), f"""
with bars as (select ticker, trade_date, cast(sec // 60 as int) as m, min_by(price, sec*1000000::bigint + tick_id) as o, max_by(price, sec*1000000::bigint + tick_id) as c
    from ticks group by ticker, trade_date, cast(sec // 60 as int)),
  moves as (select *, abs((lag(c) over w - o)/o) as move1, m - min(m) over (partition by ticker, trade_date) as age from bars window w as (partition by ticker, trade_date order by m)),
  both2 as (select *, lag(move1) over (partition by ticker, trade_date order by m) as move2 from moves),
  r as (select t.ticker, t.trade_date, t.sec, t.tick_id, t.price, t.atr14, b.age, abs((price - o)/o) as cur, move1, move2,
      case when age = 0 then 0.001D else least(age/1000.0D, 1.0D) end as w
    from ticks t join both2 b on t.ticker = b.ticker and t.trade_date = b.trade_date and cast(t.sec // 60 as int) = b.m where age < 1440)
select ticker, trade_date, sec, tick_id, cast(age as int) as minute_no,
  case when age = 0 and a = 0 then null else {rint('a/price*100.0D', 2)} end as vol_estimate
from (select *, w*atr14 + (1.0D - w)*((coalesce(move2, 0.0D) + coalesce(move1, 0.0D) + cur)/(1 + (case when move1 is null then 0 else 1 end) + (case when move2 is null then 0 else 1 end)))*price as a from r) q""")
def _(spark, sf):
    t = view(spark, sf, "ticks").select("ticker", "trade_date", "sec", "tick_id", "price", "atr14")
    # ticks are about a quarter of an hour apart here, so the blend runs over the whole day
    return ops.minute_bar_vol(t, minutes=1440, blend=1000.0).drop("price", "atr14")
