"""Queries of family J, and H3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numbers import pct_of, roi
from tickloom.operators import joins, paths, sweeps, trades as trade_ops
from tickloom.plans import texts
from tickloom.plans.fixtures import view
from tickloom.plans.q_paths import SAMPLES, SPATH, day_path, stopped_path
from tickloom.plans.registry import query, rint
from tickloom.session import FULL_DAY

TV = ("trades", "ticks")
ANCHORS, LOW, HIGH = sweeps.TARGET_1, -5, 11
DAY_BANDS = tuple(5400 * i for i in range(16))  # 15 bands over the day: these ticks span 24 hours


def sweep_entries(spark, sf):
    """Trades with the filter columns of the sweeps."""
    t = view(spark, sf, "trades")
    t = t.withColumn("pct_change", roi(F.col("entry_price"), F.col("exit_price"), F.col("side"))).withColumn(
        "duration_sec", F.col("exit_sec") - F.col("entry_sec")
    )
    e = trade_ops.entry_conditions(t, view(spark, sf, "ticks"))
    ctx = trade_ops.recent_trade_context(t).select("trade_id", "avg_last_2", "prev_lasted")
    return e.join(ctx, "trade_id").select(
        "trade_id", "ticker", "trade_date", "entry_sec", F.col("entry_vol").alias("vol"), F.col("entry_ratio").alias("ratio"),
        F.col("entry_adx28").alias("adx28"), F.col("entry_adx14").alias("adx14"), F.col("entry_adx7").alias("adx7"),
        ((F.col("entry_rsi") <= 30) | (F.col("entry_rsi") >= 70)).alias("rsi_extreme"),
        (F.abs(F.col("entry_rsi") - 50) / 100.0).alias("bias"), "avg_last_2", "prev_lasted",
    )


ENTRIES = (
    "ent as (select t.trade_id, t.entry_sec, " + rint("k.atr14/k.price*100.0D", 2) + " as vol, " + rint("k.atr14/k.atr28", 2) + " as ratio, k.adx28, k.adx14, k.adx7, "
    "k.rsi <= 30 or k.rsi >= 70 as rsi_extreme, abs(k.rsi - 50)/100.0D as bias, c.avg_last_2, c.prev_lasted from trades t "
    "join lateral (select * from ticks k where k.ticker = t.ticker and k.trade_date = t.trade_date and k.sec >= t.entry_sec order by k.sec, k.tick_id limit 1) k on true "
    "join (select trade_id, " + rint("avg(pct) over (w rows between 2 preceding and 1 preceding)", 6) + " as avg_last_2, lag(dur) over w >= 240 as prev_lasted from "
    "(select *, exit_sec - entry_sec as dur, " + rint("case when side = 'buy' then (exit_price - entry_price)/entry_price*100.0D else (entry_price - exit_price)/entry_price*100.0D end", 2) + " as pct from trades) q "
    "window w as (partition by ticker order by trade_date, entry_sec, trade_id)) c on c.trade_id = t.trade_id)"
)
HITS = (
    f"{texts.TPATH}, {texts.LADDER}, base as (select trade_id, rung, min(pos) as pos from ladder group by trade_id, rung), "
    "tr as (select trade_id, max_by(rung, pos) as last, max(pos) as rungs from ladder group by trade_id having max(pos) >= 4), "
    "aft as (select l.trade_id, a.rung as anchor, l.rung, min(l.pos) as pos from ladder l join base a on a.trade_id = l.trade_id and a.rung in ({anchors}) and l.pos > a.pos group by l.trade_id, a.rung, l.rung)"
)
SETS2 = (
    "sets as (select * from unnest([2,3,4,5]) a(t1), unnest([-5,-4,-3]) b(sl1), unnest([3,4,5,6,7,8,9]) c(t2), unnest([-3,-2,-1,0,1,2,3]) d(sl2) "
    "where sl1 < t1 - 1 and t1 < t2 and sl1 < sl2 and sl2 < t1 - 1)"
)
SETS3 = (
    "sets as (select * from unnest([2,3,4,5]) a(t1), unnest([-5,-4,-3]) b(sl1), unnest([3,4,5,6,7,8,9]) c(t2), unnest([-3,-2,-1,0,1,2,3]) d(sl2), "
    "unnest([6,7,8,9,10,11]) e(t3), unnest([2,3,4,5,6]) f(sl3) "
    "where sl1 < t1 - 1 and t1 < t2 and t2 < t3 and sl1 < sl2 and sl2 < t2 - 1 and sl2 < sl3 and sl3 < t3 - 1)"
)
SETS_TWO_TARGETS = (
    "sets as (select * from unnest(range(2, 7)) a(t1), unnest(range(-9, -2)) b(sl1), unnest(range(3, 10)) c(t2), unnest(range(-9, 8)) d(sl2) "
    "where t2 > t1 and sl2 < t2 and sl2 < t1 and sl1 < t1 and sl1 < sl2)"
)
_RACE = "from tr cross join sets s left join base b1 on b1.trade_id = tr.trade_id and b1.rung = s.t1 left join base c1 on c1.trade_id = tr.trade_id and c1.rung = s.sl1 " + " ".join(
    f"left join aft a_{n} on a_{n}.trade_id = tr.trade_id and a_{n}.anchor = s.t1 and a_{n}.rung = s.{n}" for n in ("t2", "sl2")
)
_P = lambda a: f"coalesce({a}.pos, 1073741824)"
RACE2 = (
    f"race as (select tr.trade_id, tr.last, s.*, case when {_P('c1')} < {_P('b1')} then 1 when {_P('b1')} < {_P('c1')} then "
    f"(case when {_P('a_sl2')} < {_P('a_t2')} then 2 when {_P('a_t2')} < {_P('a_sl2')} then 3 else 0 end) else 0 end as code {_RACE}), "
    "oc as (select *, cast(case code when 1 then sl1 when 2 then sl2 when 3 then t2 else last end as bigint) as tenths, cast(code = 3 as bigint) as win, "
    "cast(code in (1, 2) as bigint) as loss, cast(code = 0 as bigint) as neither from race)"
)
RACE3 = (
    f"race as (select tr.trade_id, tr.last, s.*, case when {_P('c1')} < {_P('b1')} then 1 when {_P('b1')} < {_P('c1')} then "
    f"(case when {_P('a_sl2')} < {_P('a_t2')} then 2 when {_P('a_t2')} < {_P('a_sl2')} then "
    f"(case when {_P('a_sl3')} < {_P('a_t3')} then 4 when {_P('a_t3')} < {_P('a_sl3')} then 5 else 0 end) else 0 end) else 0 end as code {_RACE} "
    + " ".join(f"left join aft a_{n} on a_{n}.trade_id = tr.trade_id and a_{n}.anchor = s.t1 and a_{n}.rung = s.{n}" for n in ("t3", "sl3"))
    + "), oc as (select *, cast(case code when 1 then sl1 when 2 then sl2 when 4 then sl3 when 5 then t3 else last end as bigint) as tenths, cast(code >= 3 as bigint) as win, "
    "cast(code in (1, 2) as bigint) as loss, cast(code = 0 as bigint) as neither from race)"
)
HITS_1 = HITS.replace("{anchors}", "2, 3, 4, 5")


HITS_ALL = HITS.replace(" having max(pos) >= 4", "")


def _hits(spark, sf, anchors=ANCHORS, low=LOW, high=HIGH, min_rungs=4):
    return sweeps.hit_table(paths.price_ladder(day_path(spark, sf), anchors), anchors, low, high, min_rungs)


@query("J1_simulate_exit", TV, f"""
with {texts.TPATH}, o as (select *, sec*1000000::bigint + tick_id as ord from tpath),
  lv as (select * from (values (0.2D), (0.3D), (0.4D), (0.5D)) a(target), (values (-0.5D), (-0.4D), (-0.3D)) b(stop)),
  f as (select trade_id, target, stop, min(case when raw_roi <= stop then ord end) as s, min(case when raw_roi >= target then ord end) as t, max_by(raw_roi, ord) as last
    from o cross join lv group by trade_id, target, stop)
select trade_id, target, stop, case when s is not null and (t is null or s <= t) then stop when t is not null then target else {rint('last', 4)} end as result from f""")
def _(spark, sf):
    return sweeps.simulate_exit(day_path(spark, sf)).drop("exit_id")


_OUT2 = "t1/10.0D as t1, sl1/10.0D as sl1, t2/10.0D as t2, sl2/10.0D as sl2"


def _tenths(df, *names):
    return df.withColumns({n: F.col(n) / 10.0 for n in names})


@query("J2_ladder_exit_2", TV, f"with {HITS_1}, {SETS2}, {RACE2} select trade_id, {_OUT2}, tenths, win, loss, neither from oc")
def _(spark, sf):
    x = sweeps.ladder_exits(_hits(spark, sf), sweeps.valid_exit_sets(2), ANCHORS, LOW, HIGH)
    return _tenths(x.drop("exit_id"), "t1", "sl1", "t2", "sl2")


@query("J3_ladder_exit_3", TV, f"with {HITS_1}, {SETS3}, {RACE3} select {_OUT2}, t3/10.0D as t3, sl3/10.0D as sl3, cast(sum(tenths) as bigint) as tenths, cast(sum(win) as bigint) as wins, cast(sum(loss) as bigint) as losses, cast(sum(neither) as bigint) as neither from oc group by t1, sl1, t2, sl2, t3, sl3")
def _(spark, sf):
    x = sweeps.ladder_exits(_hits(spark, sf), sweeps.valid_exit_sets(3), ANCHORS, LOW, HIGH)
    g = x.groupBy("t1", "sl1", "t2", "sl2", "t3", "sl3").agg(F.sum("tenths").alias("tenths"), F.sum("win").alias("wins"), F.sum("loss").alias("losses"), F.sum("neither").alias("neither"))
    return _tenths(g, "t1", "sl1", "t2", "sl2", "t3", "sl3")


def _floor(col, levels):
    return f"(values {', '.join(f'({x})' for x in levels)})"


def _numbered(levels):
    return f"(values {', '.join(f'({x}, {i})' for i, x in enumerate(levels))})"


_D = lambda levels: [f"{x}D" if isinstance(x, float) else str(x) for x in levels]


def _filters(mode: int, adx28=(0,), adx14=(0,), adx7=(0,)) -> str:
    """Check text: one row per (trade, satisfied filter), the filter numbered by ``fid``."""
    on = "e.vol >= v.vol" if mode != 1 else "e.vol >= v.vol and e.vol < (case when v.vol = 0 then 0.6D else 3.0D end)"
    dims = [("v", "vol", _D(sweeps.VOLATILITIES), on), ("q", "ratio", _D(sweeps.RATIOS), "e.ratio >= q.ratio"),
            ("g", "avg_last_2", _D(sweeps.AVG_LAST_2), "e.avg_last_2 >= g.avg_last_2")]
    dims += [(a, n, lv, f"e.{n} >= {a}.{n}") for a, n, lv in (("x", "adx28", adx28), ("y", "adx14", adx14), ("z", "adx7", adx7))]
    for a, n, flag in (("r", "rsi", "rsi_extreme"), ("m", "min4", "prev_lasted")):
        dims.append((a, n, ("'true'", "'false'", "'either'"), f"({a}.{n} = 'either' or ({a}.{n} = 'true' and e.{flag}) or ({a}.{n} = 'false' and not e.{flag}))"))
    if mode == 3:
        dims.append(("tb", "entry_time", DAY_BANDS[:-1], "e.entry_sec >= tb.entry_time and e.entry_sec < tb.entry_time + 5400"))
    fid = "0::bigint"
    for a, _, lv, _on in dims:
        fid = f"({fid})*{len(lv)} + {a}.i"
    joins_ = " ".join(f"join {_numbered(lv)} {a}({n}, i) on {cond}" for a, n, lv, cond in dims)
    return f"flt as (select e.trade_id, {fid} as fid, {', '.join(f'{a}.{n}' for a, n, _, _c in dims)} from ent e {joins_})"


@query("J4_filter_grid", TV, f"with {ENTRIES}, {_filters(2, sweeps.ADX, sweeps.ADX, sweeps.ADX)} select * exclude (trade_id, fid), count(*) as n from flt group by all")
def _(spark, sf):
    dims = sweeps.search_dims(2)
    return sweeps.filter_grid(sweep_entries(spark, sf), dims, [], {"n": F.lit(1).cast("long")})


@query("J5_valid_exit_params", TV, f"""
with {texts.TPATH}, {texts.LADDER}, c as (select rung, count(distinct trade_id) as n from ladder group by rung), {SETS3}
select t1/10.0D as t1, sl1/10.0D as sl1, t2/10.0D as t2, sl2/10.0D as sl2, t3/10.0D as t3, sl3/10.0D as sl3, coalesce(a.n, 0) as reached_t1, coalesce(b.n, 0) as reached_sl1
from sets left join c a on a.rung = t1 left join c b on b.rung = sl1""")
def _(spark, sf):
    reached = paths.first_hits(paths.price_ladder(day_path(spark, sf))).groupBy("rung").agg(F.count(F.lit(1)).alias("n"))
    sets = joins.parameter_grid(
        spark, t1=sweeps.TARGET_1, sl1=sweeps.STOP_1, t2=sweeps.TARGET_2, sl2=sweeps.STOP_2, t3=sweeps.TARGET_3, sl3=sweeps.STOP_3
    ).where("sl1 < t1 - 1 and t1 < t2 and t2 < t3 and sl1 < sl2 and sl2 < t2 - 1 and sl2 < sl3 and sl3 < t3 - 1").drop("combo_id")
    out = sets.join(reached.select(F.col("rung").alias("t1"), F.col("n").alias("reached_t1")), "t1", "left")
    out = out.join(reached.select(F.col("rung").alias("sl1"), F.col("n").alias("reached_sl1")), "sl1", "left")
    return _tenths(out.na.fill(0, ["reached_t1", "reached_sl1"]), "t1", "sl1", "t2", "sl2", "t3", "sl3")


_CELLS = (
    "sn as (select *, row_number() over (order by t1, sl1, t2, sl2) - 1 as sid from sets), "
    "oid as (select oc.trade_id, sn.sid, oc.tenths::double as tenths, oc.win::double as win, oc.loss::double as loss from oc join sn on sn.t1 = oc.t1 and sn.sl1 = oc.sl1 and sn.t2 = oc.t2 and sn.sl2 = oc.sl2), "
    "ids as (select f.fid*1000 + o.sid as cid, sum(tenths) as tenths, count(*) as n, sum(win) as wins, sum(loss) as losses "
    "from flt f join oid o on o.trade_id = f.trade_id group by 1 having sum(tenths) >= 20), "
    "fdef as (select distinct * exclude (trade_id) from flt), "
    "cells as (select d.* exclude (fid), sn.* exclude (sid), cast(i.tenths as bigint) as tenths, n, cast(wins as bigint) as wins, cast(losses as bigint) as losses, cast(n - wins - losses as bigint) as neither "
    "from ids i join fdef d on d.fid = i.cid // 1000 join sn on sn.sid = i.cid % 1000)"
)
_BEST = f"vol, ratio, avg_last_2, adx28, adx14, adx7, rsi, min4, {_OUT2}, tenths/10.0D as sum, n, wins, losses, neither, {rint('tenths/10.0D/n', 2)} as avg"
_ORDER = "tenths desc, {time}cells.vol, cells.ratio, cells.avg_last_2, cells.adx28, cells.adx14, cells.adx7, cells.rsi, cells.min4, cells.t1, cells.sl1, cells.t2, cells.sl2"


def search(spark, sf, mode: int, k: int = 10, **adx):
    dims = sweeps.search_dims(mode, times=DAY_BANDS, **adx)
    sets = sweeps.valid_exit_sets(2)
    cells = sweeps.grid_search_cells(sweep_entries(spark, sf), _hits(spark, sf), sets, ANCHORS, LOW, HIGH, dims, best=sweeps.best_of_mode(mode, k))
    return sweeps.grid_search(cells, dims, sets, mode, k).drop("exit_id")


# the check text has one level of each directional index; the whole search is J6_grid_search_mode1
@query("J6_grid_search_mode1_adx0", TV, f"with {ENTRIES}, {HITS_1}, {SETS2}, {RACE2}, {_filters(1)}, {_CELLS} select {_BEST} from (select * from cells order by {_ORDER.replace('{time}', '')} limit 10) cells")
def _(spark, sf):
    return search(spark, sf, 1, adx28=(0,), adx14=(0,), adx7=(0,))


@query("J6_grid_search_mode1")
def _(spark, sf):
    return search(spark, sf, 1)


_RANKED = "select {sel}, rank from (select *, cast(row_number() over (partition by {part} order by {order}) as int) as rank from cells) cells where rank <= 10"


# the check text has one level of each directional index; the whole search is J6_grid_search_mode2
@query("J6_grid_search_mode2_adx0", TV, f"with {ENTRIES}, {HITS_1}, {SETS2}, {RACE2}, {_filters(2)}, {_CELLS} " + _RANKED.format(sel=_BEST, part="vol", order=_ORDER.replace("{time}", "")))
def _(spark, sf):
    return search(spark, sf, 2, adx28=(0,), adx14=(0,), adx7=(0,))


@query("J6_grid_search_mode2")
def _(spark, sf):
    return search(spark, sf, 2)


# the check text has one level of each directional index; the whole search is J6_grid_search_mode3
@query("J6_grid_search_mode3_adx0", TV, f"with {ENTRIES}, {HITS_1}, {SETS2}, {RACE2}, {_filters(3)}, {_CELLS} " + _RANKED.format(sel="entry_time, " + _BEST, part="entry_time", order=_ORDER.replace("{time}", "")))
def _(spark, sf):
    return search(spark, sf, 3, adx28=(0,), adx14=(0,), adx7=(0,))


@query("J6_grid_search_mode3")
def _(spark, sf):
    return search(spark, sf, 3)


@query("J7_grid_search_ticks", TV, f"""
with {ENTRIES}, {texts.TPATH}, o as (select *, sec*1000000::bigint + tick_id as ord from tpath),
  lv as (select * from (values (0.2D), (0.3D), (0.4D), (0.5D)) a(target), (values (-0.5D), (-0.4D), (-0.3D)) b(stop)),
  f as (select trade_id, target, stop, min(case when raw_roi <= stop then ord end) as s, min(case when raw_roi >= target then ord end) as t, max_by(raw_roi, ord) as last from o cross join lv group by trade_id, target, stop),
  r as (select trade_id, target, stop, cast(round_even((case when s is not null and (t is null or s <= t) then stop when t is not null then target else last end)*10000, 0) as bigint) as units from f)
select v.vol, q.ratio, x.adx28, y.adx14, z.adx7, target, stop, cast(sum(units) as bigint)/10000.0D as total, count(*) as n
from r join ent e on e.trade_id = r.trade_id join {_floor('v', _D(sweeps.VOLATILITIES))} v(vol) on e.vol >= v.vol join {_floor('q', _D(sweeps.RATIOS))} q(ratio) on e.ratio >= q.ratio
join (values (0), (20), (30)) x(adx28) on e.adx28 >= x.adx28 join (values (0), (20), (30)) y(adx14) on e.adx14 >= y.adx14 join (values (0), (20), (30)) z(adx7) on e.adx7 >= z.adx7
group by all order by sum(units) desc, v.vol, q.ratio, x.adx28, y.adx14, z.adx7, target, stop limit 10""")
def _(spark, sf):
    return sweeps.grid_search_ticks(sweep_entries(spark, sf), sweeps.simulate_exit(day_path(spark, sf)))


_VR = (
    f"{ENTRIES}, {HITS_ALL.replace('{anchors}', '5')}, b as (select ent.*, coalesce(tr.last, 0) as last, "
    + ", ".join(f"(select coalesce(min(pos), 1073741824) from base where base.trade_id = ent.trade_id and rung = {r}) as p{i}" for i, r in enumerate((3, -3, 5, -5)))
    + ", " + ", ".join(f"(select coalesce(min(pos), 1073741824) from aft where aft.trade_id = ent.trade_id and rung = {r}) as q{i}" for i, r in enumerate((-1, 9)))
    + " from ent left join tr on tr.trade_id = ent.trade_id), rules as (select b.*, 'basic' as rule, case when p0 < p1 then 3 when p1 < p0 then -3 else last end as x from b union all "
    "select b.*, 'complex', case when p3 < p2 then -5 when p2 < p3 then (case when q0 < q1 then -1 when q1 < q0 then 9 else last end) else last end from b), "
    "vr as (select g.rule, v.vol, q.ratio, count(x) as n, "
    "count(*) filter (where (g.rule = 'basic' and x = 3) or (g.rule = 'complex' and x = 9)) as wins, count(*) filter (where g.rule = 'complex' and x = -1) as upper_sl_losses, "
    "count(*) filter (where (g.rule = 'basic' and x = -3) or (g.rule = 'complex' and x = -5)) as losses, coalesce(sum(x), 0)/10.0D as net "
    f"from (values ('basic'), ('complex')) g(rule) cross join {_floor('v', _D(sweeps.SWEEP_VOLS))} v(vol) cross join {_floor('q', _D(sweeps.SWEEP_RATIOS))} q(ratio) "
    "left join rules e on e.rule = g.rule and e.vol >= v.vol and e.ratio >= q.ratio group by g.rule, v.vol, q.ratio)"
)


def _vol_ratio(spark, sf):
    return sweeps.vol_ratio_sweep(sweep_entries(spark, sf), _hits(spark, sf, (5,), -5, 9, 1), -5)


@query("J8_vol_ratio_sweep", TV, f"with {_VR} select *, n - wins - upper_sl_losses - losses as neither from vr")
def _(spark, sf):
    return _vol_ratio(spark, sf)


@query("H3_top_5_combos", TV, f"with {_VR} select *, n - wins - upper_sl_losses - losses as neither, cast(row_number() over (partition by rule order by net desc, vol, ratio) as int) as rank from vr qualify rank <= 5")
def _(spark, sf):
    return sweeps.top_5_combos(_vol_ratio(spark, sf))


_J9_FILTERS = f"{_floor('v', _D(sweeps.PARAM_VOLS))} v(vol), {_floor('q', _D(sweeps.PARAM_RATIOS))} q(ratio), {_floor('d', _D(sweeps.PARAM_BIAS))} d(bias)"
_J9_PASS = "e.vol >= v.vol and e.ratio >= q.ratio and e.bias >= d.bias"


@query("J9_vol_ratio_param_sweep", TV, f"""
with {ENTRIES}, {HITS_ALL.replace('{anchors}', '2, 3, 4, 5, 6').replace('tr as (select', 'tr as (select ent.trade_id, coalesce(last, 0) as last from ent left join (select').replace('group by trade_id), aft', 'group by trade_id) l on l.trade_id = ent.trade_id), aft')}, {SETS_TWO_TARGETS}, {RACE2},
full_cells as (select v.vol, q.ratio, d.bias, t1, sl1, t2, sl2, cast(sum(tenths) as bigint) as tenths, count(*) as n, cast(sum(win) as bigint) as wins, cast(sum(loss) as bigint) as losses, cast(sum(neither) as bigint) as neither
  from oc join ent e on e.trade_id = oc.trade_id, {_J9_FILTERS} where {_J9_PASS} group by v.vol, q.ratio, d.bias, t1, sl1, t2, sl2),
no_cells as (select v.vol, q.ratio, d.bias, t1, sl1, t2, sl2, 0::bigint as tenths, 0::bigint as n, 0::bigint as wins, 0::bigint as losses, 0::bigint as neither from {_J9_FILTERS}, sets where not exists (select 1 from ent e where {_J9_PASS}))
select vol, ratio, bias, {_OUT2}, tenths/10.0D as sum, n, wins, losses, neither from (select * from full_cells union all select * from no_cells) c
order by tenths desc, vol, ratio, bias, c.t1, c.t2, c.sl2 desc, c.sl1 desc limit 10""")
def _(spark, sf):
    hits = _hits(spark, sf, (2, 3, 4, 5, 6), -9, 9, 1)
    return sweeps.vol_ratio_param_sweep(sweep_entries(spark, sf), hits, (2, 3, 4, 5, 6), -9, 9)


from tickloom.plans.q_trades import DAY_CURVE, _stopped  # noqa: E402


@query("J10_exit_threshold_sweep", TV, f"""
with {DAY_CURVE}, th as (select unnest([1.0D, 1.25D, 1.5D, 1.75D, 2.0D, 2.25D, 2.5D, 2.75D, 3.0D]) as threshold),
  d as (select trade_date, threshold, min_by(day_roi/6.0D, case when day_roi/6.0D >= threshold then sec end) as hit, max_by(day_roi/6.0D, sec) as fin from curve cross join th group by trade_date, threshold),
  p as (select *, coalesce(hit, fin) as profit from d)
select threshold, count(*) as days, count(hit) as days_hit, {rint('sum(profit)', 4)} as total_profit, {rint('count(hit)/count(*)*100.0D', 2)} as hit_rate,
  {rint('coalesce(avg(case when profit >= threshold then profit end), 0.0D)', 4)} as avg_hit, {rint('coalesce(avg(case when profit < threshold then profit end), 0.0D)', 4)} as avg_miss,
  row_number() over (order by {rint('sum(profit)', 4)} desc, threshold) = 1 as best
from p group by threshold""")
def _(spark, sf):
    return sweeps.exit_threshold_sweep(trade_ops.day_pnl_curve(_stopped(spark, sf)))


@query("J11_scalp_race", TV, f"""
with e as (select t.trade_id, t.ticker, t.trade_date, t.side, min(k.sec) as entry_sec, 86400 as exit_sec, min_by(k.price, k.sec) as entry_price
    from trades t join ticks k on t.ticker = k.ticker and t.trade_date = k.trade_date and k.sec // 60 = t.exit_sec // 60 group by t.trade_id, t.ticker, t.trade_date, t.side),
  {texts.PATH.replace('from trades t', 'from e t')},
  run as (select *, greatest(max(raw_roi) over ({texts.W}), 0.0D) as best, least(min(raw_roi) over ({texts.W}), 0.0D) as worst from path),
  x as (select * from run where best >= 0.4D or worst <= -0.3D qualify row_number() over ({texts.W}) = 1)
select trade_id, sec as exit_sec, {rint('best', 2)} as best_pct, {rint('worst', 2)} as worst_pct, {rint('case when best >= 0.4D then best else worst end', 2)} as exit_pct from x""")
def _(spark, sf):
    t = view(spark, sf, "trades").select("trade_id", "ticker", "trade_date", "side", F.floor(F.col("exit_sec") / 60).cast("int").alias("entry_minute"))
    k = view(spark, sf, "ticks")
    e = joins.prefix_entry(t, k).withColumn("exit_sec", F.lit(86400))
    return sweeps.scalp_race(paths.roi_path(e, k, FULL_DAY, over=sweeps.race_over(0.4, -0.3)), 0.4, -0.3)


def stopped_with_vol(spark, sf):
    return stopped_path(spark, sf, ("atr14",)).withColumn("vol", pct_of(F.col("atr14"), F.col("price")))


_SLS = (-0.2, -0.3, -0.4)


@query("J12_optimal_stop_loss", TV, f"""
with {SPATH}, g as (select trade_id, min(case when roi >= 0.6D then sec end) as t, min(case when roi <= -0.2D then sec end) as s0, min(case when roi <= -0.3D then sec end) as s1,
    min(case when roi <= -0.4D then sec end) as s2, min(sec) as f, min_by({texts.VOL}, case when true then sec*1000000::bigint + tick_id end) as v0, min(sec*1000000::bigint + tick_id) as o from spath group by trade_id),
  v as (select trade_id, {texts.VOL} as vol, sec*1000000::bigint + tick_id as o from spath)
select g.trade_id, cast(round_even(f/60.0D, 0) as int) as minutes, v.vol,
  case when t is null then -0.2D when s0 is null or t < s0 then -0.2D when s1 is null or t < s1 then -0.3D when s2 is null or t < s2 then -0.4D else -0.2D end as optimal_sl
from g join v on v.trade_id = g.trade_id and v.o = g.o where t is not null or s2 is not null""")
def _(spark, sf):
    return sweeps.optimal_stop_loss(stopped_with_vol(spark, sf), _SLS, session=FULL_DAY)


@query("J13_success_label", TV, f"""
with {SPATH}, g as (select trade_id, min(case when roi >= 0.6D then sec end) as t, min(case when roi <= -0.4D then sec end) as s from spath group by trade_id)
select trade_id, case when t is not null and (s is null or t <= s) then 1 when s is not null then 0 end as label from g""")
def _(spark, sf):
    return sweeps.success_label(stopped_path(spark, sf))


@query("J14_target_training_set", TV, f"""
with {texts.PATH}, {texts.stop_path(name='sp')}, pk as (select *, max(roi) over (partition by trade_id) as peak, max(roi) over (partition by trade_id order by sec desc, tick_id desc) as best_future from sp),
  spath as (select * from pk where peak >= 0.3D), {SAMPLES} select trade_id, minutes, {texts.VOL} as vol, best_future as roi from sampled""")
def _(spark, sf):
    return sweeps.target_training_set(stopped_with_vol(spark, sf), session=FULL_DAY)


_KEY = "concat_ws('|', " + ", ".join(f"printf('%.1f', {c})" if c not in ("rsi", "min4") else c for c in ("vol", "ratio", "avg_last_2", "adx28", "adx14", "adx7", "rsi", "min4", "t1", "sl1", "t2", "sl2")) + ")"


_FILTERS = ["vol", "ratio", "avg_last_2", "adx28", "adx14", "adx7", "rsi", "min4"]


# the check text has one level of each directional index; the whole report is J15_sweep_report
@query("J15_sweep_report_adx0", TV, f"with {ENTRIES}, {HITS_1}, {SETS2}, {RACE2}, {_filters(2)}, {_CELLS}, rep as (" + _RANKED.format(sel=_BEST, part="vol", order=_ORDER.replace("{time}", "")) + ") select vol as section, rank, "
       + _KEY.replace("printf('%.1f', adx28)", "printf('%.1f', adx28::double)").replace("printf('%.1f', adx14)", "printf('%.1f', adx14::double)").replace("printf('%.1f', adx7)", "printf('%.1f', adx7::double)")
       + " as key, sum, n, wins, losses, neither, avg, rank = 1 as best_of_section from rep")
def _(spark, sf):
    return sweeps.sweep_report(search(spark, sf, 2, adx28=(0,), adx14=(0,), adx7=(0,)), _FILTERS, "vol")


@query("J15_sweep_report")
def _(spark, sf):
    return sweeps.sweep_report(search(spark, sf, 2), _FILTERS, "vol")
