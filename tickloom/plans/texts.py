"""Check-text building blocks shared by several queries."""

from __future__ import annotations

from tickloom.plans.registry import rint


def _roi(price: str = "k.price") -> str:
    return (
        f"case when t.side = 'buy' then ({price} - t.entry_price)/t.entry_price*100.0D "
        f"else (t.entry_price - {price})/t.entry_price*100.0D end"
    )


_COLS = "t.trade_id, t.ticker, t.trade_date, t.side, t.entry_sec, t.exit_sec, t.entry_price, k.sec, k.tick_id, k.price, k.atr14, k.atr28"
VOL = rint("atr14/price*100.0D", 2)

# trade x tick, entry to end of day
PATH = f"path as (select *, {rint('raw_roi', 2)} as roi from (select {_COLS}, {_roi()} as raw_roi from trades t join ticks k on t.ticker = k.ticker and t.trade_date = k.trade_date where k.sec >= t.entry_sec) q)"
# trade x tick, entry to exit
TPATH = f"tpath as (select *, {rint('raw_roi', 2)} as roi from (select {_COLS}, {_roi()} as raw_roi from trades t join ticks k on t.ticker = k.ticker and t.trade_date = k.trade_date where k.sec between t.entry_sec and t.exit_sec) q)"
W = "partition by trade_id order by sec, tick_id"


def stop_path(hold: str = "0.6D", hold_sl: str = "0.0D", sl: str = "-0.4D", name: str = "spath", source: str = "path") -> str:
    return (
        f"{name}_a as (select *, coalesce(max(case when roi >= {hold} then 1 else 0 end) over ({W} rows between unbounded preceding and 1 preceding), 0) as armed from {source}), "
        f"{name}_b as (select *, case when roi <= {sl} or (armed = 1 and roi <= {hold_sl}) then 1 else 0 end as stopped from {name}_a), "
        f"{name} as (select * exclude (dead) from (select *, coalesce(max(stopped) over ({W} rows between unbounded preceding and 1 preceding), 0) as dead from {name}_b) q where dead = 0)"
    )


EPISODES = (
    "epi as (select *, cast(sum(case when prev = 0 then 1 else 0 end) over (partition by trade_date, ticker order by sec, fill_id) as bigint) as ep "
    "from (select *, cast(pos - qty as bigint) as prev from (select *, cast(sum(qty) over (partition by trade_date, ticker order by sec, fill_id) as bigint) as pos from fills) a) b)"
)
TRIPS = (
    "trips as (select ticker, trade_date, ep, trade_id, entry_sec, exit_sec, cast(exit_sec - entry_sec as int) as duration_sec, "
    f"{rint('p0', 4)} as entry_price, {rint('p1', 4)} as exit_price, case when q0 > 0 then 'buy' else 'short' end as side, cast(abs(q0) as int) as qty, "
    f"{rint('dollars', 2)} as dollar_change, {rint('abs(q0*p0)', 2)} as investment, {rint('dollars/abs(q0*p0)*100.0D', 2)} as pct_change, fills "
    "from (select ticker, trade_date, ep, min_by(fill_id, ord) as trade_id, min(sec) as entry_sec, max(sec) as exit_sec, min(p0) as p0, max_by(net_price, ord) as p1, min_by(qty, ord) as q0, "
    f"max_by(pos, ord) as last_pos, {rint('sum(case when prev > 0 then (net_price - p0)*abs(qty) when prev < 0 then (p0 - net_price)*abs(qty) else 0 end)', 8)} as dollars, count(*) as fills "
    "from (select *, first_value(net_price) over (partition by trade_date, ticker, ep order by sec, fill_id) as p0, "
    "row_number() over (partition by trade_date, ticker, ep order by sec, fill_id) as ord from epi) e group by ticker, trade_date, ep) g where last_pos = 0)"
)
# best and worst price between entry and exit
EXCURSIONS = (
    "exc as (select t.trade_id, t.ticker, t.trade_date, t.side, t.entry_sec, t.exit_sec, t.entry_price, t.best_price, t.worst_price, "
    f"{rint(_roi('t.best_price'), 2)} as best_pct, {rint(_roi('t.worst_price'), 2)} as worst_pct, "
    "cast(coalesce((select min(p.sec) from tpath p where p.trade_id = t.trade_id and p.price = t.best_price and p.raw_roi > 0) - t.first_sec, 0) as int) as best_sec_in_trade, "
    "cast(coalesce((select min(p.sec) from tpath p where p.trade_id = t.trade_id and p.price = t.worst_price and p.raw_roi < 0) - t.first_sec, 0) as int) as worst_sec_in_trade "
    "from (select t.*, m.first_sec, case when side = 'buy' then greatest(m.hi, t.entry_price) else least(m.lo, t.entry_price) end as best_price, "
    "case when side = 'buy' then least(m.lo, t.entry_price) else greatest(m.hi, t.entry_price) end as worst_price "
    "from trades t join (select trade_id, min(sec) as first_sec, max(price) as hi, min(price) as lo from tpath group by trade_id) m on m.trade_id = t.trade_id) t)"
)
LADDER = (
    f"lvl as (select trade_id, sec, tick_id, cast(trunc(raw_roi*10) as int) as lvl, lag(cast(trunc(raw_roi*10) as int)) over ({W}) as prev from tpath), "
    "rungs as (select trade_id, sec, tick_id, case when prev is null then [lvl] when prev < lvl then range(prev + 1, lvl + 1) when prev > lvl then range(prev - 1, lvl - 1, -1) else [] end as r from lvl), "
    "ladder as (select trade_id, cast(row_number() over (partition by trade_id order by sec, tick_id, i) as int) as pos, cast(rung as int) as rung from "
    "(select trade_id, sec, tick_id, unnest(r) as rung, generate_subscripts(r, 1) as i from rungs) q)"
)
