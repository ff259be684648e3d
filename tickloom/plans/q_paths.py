"""Queries of family F on return paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numbers import pct_of
from tickloom.operators import blocks, paths
from tickloom.plans import texts
from tickloom.plans.fixtures import view
from tickloom.plans.registry import query, rint
from tickloom.session import FULL_DAY

TV = ("trades", "ticks")
SPATH = f"{texts.PATH}, {texts.stop_path()}"


def open_path(spark, sf, extra=(), over=None, shared=False):
    return paths.roi_path(view(spark, sf, "trades"), view(spark, sf, "ticks"), FULL_DAY, extra, over, shared)


def stopped_path(spark, sf, extra=()):
    return paths.stop_state_path(open_path(spark, sf, extra, paths.at_stop()))


def day_path(spark, sf):
    return paths.trade_path(view(spark, sf, "trades"), view(spark, sf, "ticks"))


@query("F2_roi_path", TV, f"with {texts.PATH} select trade_id, sec, tick_id, roi from path")
def _(spark, sf):
    return open_path(spark, sf).select("trade_id", "sec", "tick_id", "roi")


@query("F3_excursions", TV, f"with {texts.TPATH}, {texts.EXCURSIONS} select trade_id, best_price, best_pct, best_sec_in_trade, worst_price, worst_pct, worst_sec_in_trade, best_pct >= 0.6D as holding_reached from exc")
def _(spark, sf):
    x = paths.excursions(view(spark, sf, "trades"), view(spark, sf, "ticks"))
    return x.select("trade_id", "best_price", "best_pct", "best_sec_in_trade", "worst_price", "worst_pct", "worst_sec_in_trade", "holding_reached")


@query("F4_stop_state_path", TV, f"with {SPATH} select trade_id, sec, tick_id, roi, cast(armed as int) as armed, stopped from spath")
def _(spark, sf):
    return stopped_path(spark, sf).select("trade_id", "sec", "tick_id", "roi", "armed", "stopped")


@query("F5_best_future_roi", TV, f"with {SPATH} select trade_id, tick_id, roi, max(roi) over (partition by trade_id order by sec desc, tick_id desc) as best_future from spath")
def _(spark, sf):
    return paths.best_future_roi(stopped_path(spark, sf)).select("trade_id", "tick_id", "roi", "best_future")


SAMPLES = (
    "mins as (select *, cast(round_even(sec/60.0D, 0) as int) as minutes from spath), "
    f"stepped as (select *, cast((minutes - first_value(minutes) over ({texts.W})) // 10 as int) as step from mins), "
    "sampled as (select * from stepped qualify row_number() over (partition by trade_id, step order by sec, tick_id) = 1)"
)


@query("F6_sample_every", TV, f"with {SPATH}, {SAMPLES} select trade_id, tick_id, minutes, step, roi from sampled")
def _(spark, sf):
    return paths.sample_every(stopped_path(spark, sf), 10, FULL_DAY).select("trade_id", "tick_id", "minutes", "step", "roi")


@query("F7_price_ladder", TV, f"with {texts.TPATH}, {texts.LADDER} select trade_id, pos, rung from ladder")
def _(spark, sf):
    return paths.price_ladder(day_path(spark, sf))


@query("F8_first_hit", TV, f"with {texts.TPATH}, {texts.LADDER} select trade_id, rung, min(pos) as pos from ladder group by trade_id, rung")
def _(spark, sf):
    return paths.first_hits(paths.price_ladder(day_path(spark, sf)))


@query("F8_first_cross", TV, f"""
with {texts.TPATH} select trade_id, min(case when roi >= 0.3D then sec end) as up_03, min(case when roi >= 0.6D then sec end) as up_06,
  min(case when roi <= -0.3D then sec end) as down_03, min(case when roi <= -0.5D then sec end) as down_05 from tpath group by trade_id""")
def _(spark, sf):
    x = paths.first_cross(day_path(spark, sf), up=(0.3, 0.6), down=(-0.3, -0.5))
    return x.select("trade_id", F.col("up_0.sec").alias("up_03"), F.col("up_1.sec").alias("up_06"), F.col("down_0.sec").alias("down_03"), F.col("down_1.sec").alias("down_05"))


@query("F9_first_hit_after", TV, f"""
with {texts.TPATH}, {texts.LADDER}, a as (select trade_id, rung as anchor, min(pos) as at from ladder where rung in (2, 3, 4, 5) group by trade_id, rung)
select l.trade_id, a.anchor, l.rung, min(l.pos) as pos from ladder l join a on a.trade_id = l.trade_id and l.pos > a.at group by l.trade_id, a.anchor, l.rung""")
def _(spark, sf):
    return paths.first_hits_after(paths.price_ladder(day_path(spark, sf)), (2, 3, 4, 5))


@query("F10_best_stop_loss", TV, f"""
with {texts.PATH}, rel as (select trade_id, sec, tick_id, case when side = 'buy' then (price - p0)/p0*100.0D else (p0 - price)/p0*100.0D end as r
    from (select *, first_value(price) over ({texts.W}) as p0 from path) q),
  hit as (select trade_id, min(sec) as at from rel where r >= 0.6D group by trade_id)
select rel.trade_id, case when min(hit.at) is not null then {rint('least(min(case when rel.sec <= hit.at then r end), 0.0D) - 0.1D', 2)} end as best_sl
from rel left join hit on hit.trade_id = rel.trade_id group by rel.trade_id""")
def _(spark, sf):
    return paths.best_stop_loss(view(spark, sf, "trades"), view(spark, sf, "ticks"), session=FULL_DAY)


_FLAGS = (
    f"{texts.TPATH}, {texts.PATH}, {texts.EXCURSIONS}, "
    f"f1 as (select p.*, max(case when raw_roi >= 0.6D then 1 else 0 end) over (partition by p.trade_id order by p.sec, p.tick_id) as reached from path p join exc x on x.trade_id = p.trade_id and x.best_pct >= 0.6D), "
    f"f2 as (select *, max(case when reached = 1 and sec >= exit_sec and ((side = 'buy' and price <= entry_price) or (side <> 'buy' and price >= entry_price)) then 1 else 0 end) over ({texts.W}) as returned from f1), "
    "f3 as (select *, sec*1000000::bigint + tick_id as ord, case when returned = 1 then 0.0D else roi end as now from f2)"
)


@query("F11_horizon_roi", TV, f"with {_FLAGS} select trade_id, " + ", ".join(
    f"coalesce(min_by(now, case when sec - entry_sec >= {s} then ord end), max_by(now, ord)) as {n}"
    for n, s in (("roi_1h", 3600), ("roi_1_5h", 5400), ("roi_2h", 7200), ("roi_2_5h", 9000), ("roi_3h", 10800))
) + " from f3 group by trade_id")
def _(spark, sf):
    return paths.horizon_roi(view(spark, sf, "trades"), view(spark, sf, "ticks"), session=FULL_DAY)


@query("F12_target_attain", TV, f"with {_FLAGS} select trade_id, " + ", ".join(
    f"case when max(reached) = 1 then coalesce(min_by(case when returned = 1 then 0.0D else {p} end, case when reached = 1 and (returned = 1 or raw_roi >= {p}) then ord end), max_by(roi, ord)) end as {n}"
    for n, p in (("pct_1", "1.0D"), ("pct_2", "2.0D"), ("pct_2_5", "2.5D"), ("pct_3", "3.0D"), ("pct_3_5", "3.5D"), ("pct_4", "4.0D"))
) + " from f3 group by trade_id")
def _(spark, sf):
    return paths.target_attain(view(spark, sf, "trades"), view(spark, sf, "ticks"), session=FULL_DAY)


EXITS = (
    "m1 as (select *, cast(round_even(sec/60.0D, 0) as int) as m, " + rint("atr14/price*100.0D", 2) + " as vol from spath), "
    f"m2 as (select *, (m - first_value(m) over ({texts.W})) // 5 as step from m1), "
    f"m3 as (select *, lag(step) over ({texts.W}) as pstep from m2), "
    "m4 as (select *, case when pstep is null or step <> pstep then 0.2D + vol*0.5D + m*0.0001D end as fresh from m3), "
    f"m5 as (select *, last_value(fresh ignore nulls) over ({texts.W} rows between unbounded preceding and current row) as target, sec*1000000::bigint + tick_id as ord from m4), "
    "exits as (select trade_id, ticker, trade_date, entry_sec, coalesce(min_by(sec, case when roi >= target then ord end), max_by(sec, ord)) as exit_sec, "
    "coalesce(min_by(roi, case when roi >= target then ord end), max_by(roi, ord)) as roi, "
    "case when min(case when roi >= target then ord end) is not null then 'roi hit' else 'roi not hit' end as status from m5 group by trade_id, ticker, trade_date, entry_sec)"
)


def model_exits(spark, sf):
    path = stopped_path(spark, sf, ("atr14",))
    path = path.withColumn("vol", pct_of(F.col("atr14"), F.col("price")))
    return paths.reevaluated_exit(path, lambda m, vol: F.lit(0.2) + vol * 0.5 + m * 0.0001, 5, FULL_DAY)


@query("F17_reevaluated_exit", TV, f"with {SPATH}, {EXITS} select * from exits")
def _(spark, sf):
    return model_exits(spark, sf)


CONTRIB = (
    "contrib as (select tick_id as sample_id, tick_id % 3 as class, f.feature, case f.feature when 'adx28' then adx28 - 30 when 'adx14' then adx14 - 26 when 'rsi' then rsi - 50 else adx7 - 23 end / 10.0D as contribution "
    "from ticks, (values ('adx28'), ('adx14'), ('adx7'), ('rsi')) f(feature))"
)


def contributions(spark, sf):
    """Signed feature scores per sample in long form, shaped like per-class attribution values."""
    t = view(spark, sf, "ticks")
    scores = F.array(*[
        F.struct(F.lit(name).alias("feature"), ((F.col(name) - mid) / F.lit(10.0)).alias("contribution"))
        for name, mid in (("adx28", 30), ("adx14", 26), ("adx7", 23), ("rsi", 50))
    ])
    return t.select(F.col("tick_id").alias("sample_id"), (F.col("tick_id") % 3).alias("class"), F.explode(scores).alias("s")).select(
        "sample_id", "class", "s.feature", "s.contribution"
    )


@query("F18_rank_within_row", ("ticks",), f"with {CONTRIB} select *, row_number() over (partition by sample_id, class order by abs(contribution) desc, feature) as rank from contrib")
def _(spark, sf):
    return paths.rank_within_row(contributions(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("F19_first_reach_time", ("ticks",), f"select ticker, trade_date, min(case when {texts.VOL} >= 0.95D then sec end) as first_sec from ticks group by ticker, trade_date")
def _(spark, sf):
    t = view(spark, sf, "ticks").withColumn("vol", pct_of(F.col("atr14"), F.col("price")))
    return paths.first_reach_time(t, 0.95)


@query("F20_tick_gap", ("ticks",), "select trade_date, tick_id, sec - lag(sec) over (partition by trade_date order by sec, tick_id) as gap from ticks")
def _(spark, sf):
    t = view(spark, sf, "ticks").select("trade_date", "sec", "tick_id")
    return paths.tick_gap(t).select("trade_date", "tick_id", "gap")
