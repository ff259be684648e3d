"""Queries of families G, H and I."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import joins, paths, stats, trades as trade_ops
from tickloom.plans import texts
from tickloom.plans.fixtures import view
from tickloom.plans.q_paths import CONTRIB, EXITS, SPATH, contributions, model_exits, open_path
from tickloom.plans.registry import query, rint
from tickloom.session import stage

TV = ("trades", "ticks")
WT = ("wide_trades",)


def _s(e: str, n: int = 6) -> str:
    return rint(e, n)


def _m(e: str) -> str:
    return rint(rint(e, 6), 2)


_SUM = (
    f"{_m('sum(pct_change)')} as total_pct, {_m('sum(dollar_change)')} as total_dollars, count(*) as trades, "
    f"count(*) filter (where best_pct > 0.6D) as holders, {_m('coalesce(sum(case when best_pct > 0.6D then pct_change end), 0.0D)')} as holder_pct, "
    f"count(*) filter (where pct_change < -0.3D) as fails, {_m('coalesce(sum(case when pct_change < -0.3D then pct_change end), 0.0D)')} as fail_pct"
)


@query("G1_day_summary", WT, f"select trade_date, {_SUM} from wide_trades group by trade_date")
def _(spark, sf):
    return stats.day_summary(view(spark, sf, "wide_trades"))


@query("G2_ticker_day_summary", WT, f"select trade_date, ticker, {_SUM} from wide_trades group by trade_date, ticker")
def _(spark, sf):
    return stats.ticker_day_summary(view(spark, sf, "wide_trades"))


# the flagship: fills -> round trips -> ticks inside each trade -> excursions -> summary
@query("G3_overall_summary", ("fills", "trades", "ticks"), f"""
with {texts.EPISODES}, {texts.TRIPS}, {texts.TPATH}, {texts.EXCURSIONS},
  s as (select r.*, x.best_pct from trips r join exc x on x.trade_id = r.trade_id),
  g as (select ticker, {_SUM} from s group by grouping sets ((), (ticker))), d as (select count(distinct trade_date) as days from s)
select g.*, d.days, {rint('total_pct/days', 2)} as total_pct_per_day, {rint('holder_pct/days', 2)} as holder_pct_per_day, {rint('fail_pct/days', 2)} as fail_pct_per_day from g, d""")
def _(spark, sf):
    trips = stage(trade_ops.round_trips(trade_ops.position_episodes(view(spark, sf, "fills"))))
    best = paths.excursions(trips, view(spark, sf, "ticks")).select("trade_id", "best_pct")
    return stats.overall_summary(trips.join(best, "trade_id"))


_RG = (
    "d as (select trade_date, " + _s("sum({v})") + " as s from {src} group by trade_date) select count(*) as days, count(*) filter (where s < 0) as red_days, count(*) filter (where s >= 0) as green_days, "
    + rint(rint("coalesce(avg(case when s < 0 then s end), 0.0D)/6.0D", 6), 2) + " as avg_red_day, " + rint(rint("coalesce(avg(case when s >= 0 then s end), 0.0D)/6.0D", 6), 2) + " as avg_green_day from d"
)


@query("G4_red_green_days", WT, "with " + _RG.replace("{v}", "pct_change").replace("{src}", "wide_trades"))
def _(spark, sf):
    return stats.red_green_days(view(spark, sf, "wide_trades"), "pct_change")


_HOLD = (
    f"{texts.PATH}, hv as (select unnest([0.4D, 0.5D, 0.6D, 0.7D, 0.8D, 0.9D, 1.0D]) as hold), "
    "hp as (select path.*, hold, path.trade_id*100 + cast(hold*10 as int) as hid from path cross join hv), "
    "ha as (select *, coalesce(max(case when roi >= hold then 1 else 0 end) over (partition by hid order by sec, tick_id rows between unbounded preceding and 1 preceding), 0) as armed from hp), "
    "hb as (select *, coalesce(max(case when roi <= -0.4D or (armed = 1 and roi <= 0.0D) then 1 else 0 end) over (partition by hid order by sec, tick_id rows between unbounded preceding and 1 preceding), 0) as dead from ha), "
    "fin as (select trade_id, ticker, trade_date, entry_sec, hold, max_by(roi, sec*1000000::bigint + tick_id) as final_roi from hb where dead = 0 group by trade_id, ticker, trade_date, entry_sec, hold)"
)
_REACH = "count(*) as trades, cast(sum(case when final_roi >= hold or (final_roi < 0.1D and final_roi > -0.1D) then 1 else 0 end) as bigint) as reached, " + _m("sum(final_roi)") + " as total_roi"


#: every holding value is decided by the stop, or by the first later return to 0 once the highest of them was reached
HOLDS_OVER = paths.at_stop(hold=max(stats.HOLD_VALUES))


@query("G5_holding_value_sweep", TV, f"with {_HOLD} select hold, ticker, trade_date, {_REACH} from fin group by grouping sets ((hold), (hold, ticker), (hold, trade_date))")
def _(spark, sf):
    return stats.holding_value_sweep(stats.holding_outcomes(open_path(spark, sf, over=HOLDS_OVER, shared=True)))


@query("G6_holding_by_vol_band", TV, f"""
with {_HOLD}, b as (select fin.*, case when vol < 0.3D then 0 when vol < 0.5D then 1 when vol < 0.7D then 2 else 3 end as band from fin
  join (select tick_id, {texts.VOL} as vol from ticks) k on k.tick_id = fin.trade_id where fin.entry_sec >= 24000 and vol >= 0 and vol < 5.0D)
select band, hold, ticker, trade_date, {_REACH} from b group by grouping sets ((band, hold), (band, hold, ticker), (band, hold, trade_date))""")
def _(spark, sf):
    out = stats.holding_outcomes(open_path(spark, sf, over=HOLDS_OVER, shared=True)).where("entry_sec >= 24000")
    vol = trade_ops.entry_conditions(view(spark, sf, "trades"), view(spark, sf, "ticks")).select("trade_id", "entry_vol")
    banded = out.join(vol, "trade_id").withColumn("band", joins.band_of(F.col("entry_vol"), (0.0, 0.3, 0.5, 0.7, 5.0))).where("band is not null")
    return stats.holding_value_sweep(banded, ("band", "hold"))


@query("G7_entry_bucket_roi", WT, f"""
select bucket, {_m('sum(pct_change)')} as roi_sum, count(*) as trades from (select *, cast(greatest((entry_sec // 60 - 390) // 10, 0) as int) as bucket from wide_trades) q where bucket < 6 group by bucket""")
def _(spark, sf):
    return stats.entry_bucket_roi(view(spark, sf, "wide_trades"), value="pct_change")


@query("G8_backtest_totals", TV, f"""
with {SPATH}, {EXITS}, g as (select trade_date, ticker, count(*) as trades, count(distinct trade_date) as days, {_s('sum(roi)')} as s from exits group by grouping sets ((), (trade_date), (trade_date, ticker)))
select trade_date, ticker, trades, {rint('s', 2)} as total, {rint('s/trades', 4)} as avg_per_trade, {rint(rint('s/trades', 4) + '/6.0D', 4)} as avg_per_trade_6,
  {rint('s/days', 2)} as avg_per_day, {rint(rint('s/days', 2) + '/6.0D', 2)} as avg_per_day_6 from g""")
def _(spark, sf):
    return stats.backtest_totals(model_exits(spark, sf))


_PS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("G9_response_distribution", ("samples",), f"""
with m as (select avg(y) as mu, stddev_pop(y) as sd from samples), c as (select avg(power(y - mu, 3))/power(min(sd), 3) as skew, avg(power(y - mu, 4))/power(min(sd), 4) - 3 as kurt from samples, m)
select count(y) as count, {_s('min(y)')} as min, {_s('max(y)')} as max, {_s('avg(y)')} as mean, {_s('stddev_pop(y)')} as std, {_s('min(c.skew)')} as skew, {_s('min(c.kurt)')} as kurtosis,
  {_s('avg(case when y < 0 then 1.0D else 0.0D end)')} as share_negative, {_s('avg(case when y >= 0.6D then 1.0D else 0.0D end)')} as share_holding,
  {_s('avg(case when y >= 0 and y < 0.1D then 1.0D else 0.0D end)')} as share_small, """ + ", ".join(f"{_s(f'quantile_cont(y, {p / 100})')} as p{p}" for p in _PS) + " from samples, c")
def _(spark, sf):
    return stats.response_distribution(view(spark, sf, "samples"))


_RES = (
    "r as (select *, y - y_hat as res from {src}), md as (select quantile_cont(y_hat, 0.5) as med from r), "
    "v as (select var_pop(case when y_hat <= med then res end) as v1, var_pop(case when y_hat > med then res end) as v2 from r, md) "
    f"select count(*) as n, count(distinct trade_id) as trades, {_s('avg(res)')} as mean_residual, {_s('stddev_pop(res)')} as std_residual, {_s('min(res)')} as min_residual, {_s('max(res)')} as max_residual, "
    f"{_s('corr(y_hat, res)')} as corr_fitted_residual, {_s('max(greatest(v1, v2)/least(v1, v2))')} as variance_ratio from r, v"
)


@query("G10_residual_diagnostics", ("samples",), "with " + _RES.replace("{src}", "samples"))
def _(spark, sf):
    return stats.residual_diagnostics(view(spark, sf, "samples"))


@query("G11_residual_diagnostics_per_trade", ("samples",), "with pt as (select trade_id, y_hat, y_hat + rs as y from (select trade_id, " + _s("avg(y - y_hat)", 9) + " as rs, " + _s("avg(y_hat)", 9) + " as y_hat from samples group by trade_id) q), " + _RES.replace("{src}", "pt"))
def _(spark, sf):
    return stats.residual_diagnostics_per_trade(view(spark, sf, "samples"))


@query("G12_smearing_factor", ("samples",), f"with w as (select *, 1.0D/count(*) over (partition by trade_id) as weight from samples) select {_s('sum(weight*exp(y/4 - y_hat/4))/sum(weight)')} as smearing from w")
def _(spark, sf):
    w = stats.group_weights(view(spark, sf, "samples")).withColumns({"y": F.col("y") / 4, "y_hat": F.col("y_hat") / 4})
    return stats.smearing_factor(w)


@query("G13_group_weights", ("samples",), f"select sample_id, trade_id, {_s('1.0D/count(*) over (partition by trade_id)', 9)} as weight from samples")
def _(spark, sf):
    return stats.group_weights(view(spark, sf, "samples")).select("sample_id", "trade_id", stats.settle(F.col("weight"), 9).alias("weight"))


@query("G14_class_weights", ("predictions",), f"select label, n, {_s('sum(n) over ()/(2.0D*n)')} as weight from (select label, count(*) as n from predictions where label is not null group by label) q")
def _(spark, sf):
    return stats.class_weights(view(spark, sf, "predictions"))


@query("G15_strat_labels", ("samples",), """
with e as (select list_sort(list_distinct(quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from samples)
select sample_id, cast(len(list_filter(e[2:len(e) - 1], lambda x: x <= y)) as int) as label from samples, e""")
def _(spark, sf):
    return stats.strat_labels(view(spark, sf, "samples")).select("sample_id", "label")


# fixed values: entry windows of the duration report (08:10-08:30 is not in the list)
WINDOW_STARTS = tuple(23400 + 600 * i for i in range(10)) + (30600, 31200, 31800, 32400)
_WIN = f"w as (select t.*, s as window_start from wide_trades t join (values {', '.join(f'({x})' for x in WINDOW_STARTS)}) v(s) on entry_sec >= s and entry_sec < s + 600)"


@query("G16_duration_window_stats", WT, f"with {_WIN} select window_start, count(*) as n, {_s('avg(duration_sec)/60.0D')} as avg_minutes, {_s('quantile_cont(duration_sec, 0.5)/60.0D')} as median_minutes from w group by window_start")
def _(spark, sf):
    return stats.duration_window_stats(view(spark, sf, "wide_trades"), WINDOW_STARTS)


@query("G16_duration_by_result", WT, f"with {_WIN} select window_start, pct_change, count(*) as n, {_s('avg(duration_sec)/60.0D')} as avg_minutes, {_s('quantile_cont(duration_sec, 0.5)/60.0D')} as median_minutes from w group by window_start, pct_change")
def _(spark, sf):
    return stats.duration_window_stats(view(spark, sf, "wide_trades"), WINDOW_STARTS, result="pct_change")


def _area(start):
    """The density of r beyond ``start``, summed over 2,000 panels."""
    step = f"((least(1.0D, {start} + 12.0D/sqrt(n - 2.0D)) - {start})/2000)"
    at = f"({start} + {step}*i)"
    return f"({step}*list_sum([(case when i in (0, 2000) then 1.0D when i % 2 = 1 then 4.0D else 2.0D end)*pow(greatest(0.0D, 1.0D - {at}*{at}), (n - 4.0D)/2.0D) for i in range(0, 2001)]))"


@query("G17_ordinal_result_corr", WT, f"""
with s as (select duration_sec, case when pct_change = 0.9D then 3 when pct_change > 0 then 2 when pct_change = 0 then 1 when pct_change >= -0.3D then -1 when pct_change >= -0.5D then -2 else -3 end as sc from wide_trades),
  g as (select count(*) as n, {_s('corr(duration_sec, sc)')} as r from s)
select n, r, case when n > 10 then {_s('r*sqrt(n - 2.0D)/sqrt(1.0D - r*r)')} end as t, case when n > 10 then {_s(_area('abs(r)') + ' / ' + _area('0.0D'))} end as p from g""")
def _(spark, sf):
    return stats.ordinal_result_corr(view(spark, sf, "wide_trades"))


@query("G18_duration_buckets", WT, f"""
select bucket, count(*) as n, {rint('avg(case when pct_change = 0.8D then 1.0D else 0.0D end)*100.0D', 2)} as win_pct, {rint('avg(case when pct_change < 0 then 1.0D else 0.0D end)*100.0D', 2)} as loss_pct
from (select *, case when duration_sec < 120 then 0 when duration_sec < 300 then 1 when duration_sec < 600 then 2 when duration_sec < 900 then 3 when duration_sec < 1800 then 4 else 5 end as bucket from wide_trades) q group by bucket""")
def _(spark, sf):
    return stats.duration_buckets(view(spark, sf, "wide_trades"), win=0.8)


_COLS = ("vol", "ratio", "adx28", "pct_change")
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


@query("G19_pearson_matrix", WT, " union all ".join(f"select '{a}' as a, '{b}' as b, {_s(f'corr({a}, {b})')} as r from wide_trades" for a, b in _PAIRS))
def _(spark, sf):
    return stats.pearson_matrix(view(spark, sf, "wide_trades"), _COLS)


_RANKS = "rk as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0D as {c}" for c in _COLS) + " from wide_trades)"


@query("G20_spearman_matrix", WT, f"with {_RANKS} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {_s(f'corr({a}, {b})')} as rho from rk" for a, b in _PAIRS))
def _(spark, sf):
    return stats.spearman_matrix(view(spark, sf, "wide_trades"), _COLS)


@query("G21_mutual_information", WT, f"""
with n as (select count(*)::double as n from wide_trades), b as (select cast(floor((rank() over (order by vol) - 1)*8/n) as int) as x, cast(floor((rank() over (order by pct_change) - 1)*8/n) as int) as y, n from wide_trades, n),
  c as (select x, y, count(*)/min(n) as p from b group by x, y), d as (select *, sum(p) over (partition by x) as px, sum(p) over (partition by y) as py from c)
select {_s('sum(p*ln(p/(px*py)))')} as mi from d""")
def _(spark, sf):
    return stats.mutual_information(view(spark, sf, "wide_trades"), "vol", "pct_change")


@query("G22_success_rate_by", WT, f"""
with q as (select quantile_cont(vol, [0.25, 0.5, 0.75]) as q from wide_trades),
  b as (select case when pct_change > 0 then 1.0D else 0.0D end as s, cast((entry_sec - 23400) // 3600 as varchar) as h, cast(len(list_filter(q.q, lambda x: x < vol)) as varchar) as v, cast(adx7 % 3 as varchar) as l from wide_trades, q)
select 'hour' as grouping, h as band, count(*) as n, {_s('avg(s)')} as success_share from b group by h union all select 'vol_quartile', v, count(*), {_s('avg(s)')} from b group by v
union all select 'stop_loss', l, count(*), {_s('avg(s)')} from b group by l""")
def _(spark, sf):
    t = view(spark, sf, "wide_trades")
    q = stats.exact_quantiles(t, "vol", [0.25, 0.5, 0.75]).select("q").scalar()
    t = t.withColumn("_q", q)
    quartile = F.size(F.filter("_q", lambda e: e < F.col("vol")))
    hour = F.floor((F.col("entry_sec") - 23400) / 3600)
    return stats.success_rate_by(t, {"hour": hour, "vol_quartile": quartile, "stop_loss": F.col("adx7") % 3}, F.col("pct_change") > 0)


@query("G23_classification_metrics", ("predictions",), f"""
with c as (select k.c as class, count(*) filter (where label = k.c and pred = k.c) as tp, count(*) filter (where label = k.c) as support, count(*) filter (where pred = k.c) as predicted from predictions, (values (0), (1)) k(c) group by k.c),
  m as (select *, coalesce(tp/nullif(predicted, 0), 0.0D) as precision, coalesce(tp/nullif(support, 0), 0.0D) as recall from c), f as (select *, coalesce(precision*recall*2.0D/nullif(precision + recall, 0), 0.0D) as f1 from m)
select cast(class as varchar) as class, support, {_s('precision')} as precision, {_s('recall')} as recall, {_s('f1')} as f1, cast(null as double) as accuracy from f
union all select 'all', cast(sum(support) as bigint), {_s('sum(precision*support)/sum(support)')}, {_s('sum(recall*support)/sum(support)')}, {_s('sum(f1*support)/sum(support)')}, {_s('sum(tp)/sum(support)')} from f""")
def _(spark, sf):
    return stats.classification_metrics(view(spark, sf, "predictions"))


@query("G23_confusion_matrix", ("predictions",), "select label, pred, count(*) as n from predictions group by label, pred")
def _(spark, sf):
    return stats.confusion(view(spark, sf, "predictions"))


@query("G24_regression_metrics", ("samples",), f"""
with w as (select *, 1.0D/(1 + sample_id % 5) as w from samples) select {_s('sqrt(sum(w*(y - y_hat)*(y - y_hat))/sum(w))')} as rmse, {_s('sum(w*abs(y - y_hat))/sum(w)')} as mae,
  {_s('1.0D - sum(w*(y - y_hat)*(y - y_hat))/(sum(w*y*y) - sum(w*y)*sum(w*y)/sum(w))')} as r2 from w""")
def _(spark, sf):
    return stats.regression_metrics(view(spark, sf, "samples"), weight=F.lit(1.0) / (F.lit(1) + F.col("sample_id") % 5))


@query("G25_probability_metrics", ("predictions",), f"""
with r as (select label, prob, rank() over (order by prob) + (count(*) over (partition by prob) - 1)/2.0D as rk, greatest(least(prob, 1 - 1e-15), 1e-15) as p from predictions),
  s as (select cast(count(*) as bigint) as n, cast(sum(label) as double) as np, count(*) - sum(label) as nq, sum(case when label = 1 then rk else 0 end) as rs,
    sum(case when label = 1 then (1 - prob)*(1 - prob) else prob*prob end) as b, sum(case when label = 1 then -ln(p) else -ln(1.0D - p) end) as l from r)
select n, {_s('b/n')} as brier, {_s('l*2.0D/n')} as deviance, {_s('(rs - np*(np + 1)/2.0D)/(np*nq)')} as auc from s""")
def _(spark, sf):
    return stats.probability_metrics(view(spark, sf, "predictions"))


@query("G26_label_distribution", ("predictions",), f"select label, count(*) as n, {rint('count(*)/sum(count(*)) over ()*100.0D', 2)} as pct from predictions group by label")
def _(spark, sf):
    return stats.label_distribution(view(spark, sf, "predictions"), "label")


@query("G27_confidence_stats", ("predictions",), f"""
select pred, count(*) as n, {_s('avg(c)')} as mean_conf, {_s('min(c)')} as min_conf, {_s('max(c)')} as max_conf from (select pred, greatest(prob, 1.0D - prob) as c from predictions) q group by grouping sets ((), (pred))""")
def _(spark, sf):
    return stats.confidence_stats(view(spark, sf, "predictions"))


@query("G28_feature_ranges", WT, " union all ".join(f"select '{c}' as feature, min({c})::double as lo, max({c})::double as hi from wide_trades" for c in ("vol", "ratio", "adx28", "duration_sec")))
def _(spark, sf):
    return stats.feature_ranges(view(spark, sf, "wide_trades"), ("vol", "ratio", "adx28", "duration_sec"))


@query("G29_ticker_frequency", ("ticks",), "select ticker, count(*) as n, (select count(distinct ticker) from ticks) as tickers from ticks group by ticker order by n desc, ticker limit 5")
def _(spark, sf):
    return stats.ticker_frequency(view(spark, sf, "ticks"))


@query("G30_attribution_summary", ("ticks",), f"with {CONTRIB}, r as (select *, row_number() over (partition by sample_id, class order by abs(contribution) desc, feature) as rank from contrib) select class, feature, {_s('sum(contribution)')} as contribution, {_s('avg(rank)')} as avg_rank from r group by class, feature")
def _(spark, sf):
    return stats.attribution_summary(paths.rank_within_row(contributions(spark, sf)))


@query("G31_density_2d", WT, """
select cast(case when vol < 0 then 0 when vol >= 1 then 11 else floor(vol*10/1.0D) + 1 end as int) as x_bin, cast(case when pct_change < -1 then 0 when pct_change >= 1 then 11 else floor((pct_change + 1.0D)*10/2.0D) + 1 end as int) as y_bin, count(*) as n
from wide_trades group by 1, 2""")
def _(spark, sf):
    return stats.density_2d(view(spark, sf, "wide_trades"), "vol", "pct_change", (0, 1), (-1, 1))


_T = "trade_id, ticker, pct_change"


@query("H1_top_k", WT, f"select {_T} from wide_trades order by pct_change desc, trade_id limit 10")
def _(spark, sf):
    return stats.top_k(view(spark, sf, "wide_trades").select("trade_id", "ticker", "pct_change"), "pct_change", ["trade_id"])


@query("H2_top_k_per", WT, f"select {_T}, cast(row_number() over (partition by ticker order by pct_change desc, trade_id) as int) as rank from wide_trades qualify rank <= 10")
def _(spark, sf):
    return stats.top_k_per(view(spark, sf, "wide_trades").select("trade_id", "ticker", "pct_change"), "ticker", "pct_change", ["trade_id"])


@query("H4_argmax", WT, f"select duration_sec, total from (select duration_sec, {_s('sum(pct_change)')} as total from wide_trades group by duration_sec) q order by total desc, duration_sec limit 1")
def _(spark, sf):
    g = view(spark, sf, "wide_trades").groupBy("duration_sec").agg(stats.settle(F.sum("pct_change")).alias("total"))
    return stats.argmax(g, "total", "duration_sec")


@query("H5_sort_desc_time", ("fills",), "select fill_id, trade_date, sec from fills order by trade_date desc, sec desc, fill_id")
def _(spark, sf):
    f = view(spark, sf, "fills").select("fill_id", "trade_date", "sec")
    return stats.sort_desc_time(f, ["trade_date", "sec"], "fill_id")


@query("H6_sort_by_column", ("ticks",), "select tick_id, price, min(price) over () as lowest, max(price) over () as highest from ticks order by price desc")
def _(spark, sf):
    return stats.sort_by_column(view(spark, sf, "ticks").select("tick_id", "price"), "price")


@query("H7_head_n", WT, f"select {_T} from wide_trades order by trade_date, entry_sec, trade_id limit 21")
def _(spark, sf):
    return stats.head_n(view(spark, sf, "wide_trades"), ["trade_date", "entry_sec", "trade_id"]).select("trade_id", "ticker", "pct_change")


@query("H8_rows_by_index_range", WT, """
with o as (select trade_id as row_index, (trade_id*7919) % 100003 as position from wide_trades)
select o.position, w.trade_id as row_index, w.ticker, w.pct_change from o join wide_trades w on w.trade_id = o.row_index where position between 1000 and 9000""")
def _(spark, sf):
    t = view(spark, sf, "wide_trades").select(F.col("trade_id").alias("row_index"), "ticker", "pct_change")
    order = t.select("row_index", ((F.col("row_index") * 7919) % 100003).alias("position"))
    return stats.rows_by_index_range(t, order, 1000, 9000)


@query("I1_union_all", ("ticks", "fills"), "select ticker, trade_date, sec, price, cast(null as int) as qty from ticks union all select ticker, trade_date, sec, net_price, qty from fills")
def _(spark, sf):
    t = view(spark, sf, "ticks").select("ticker", "trade_date", "sec", "price")
    f = view(spark, sf, "fills").select("ticker", "trade_date", "sec", F.col("net_price").alias("price"), "qty")
    return stats.union_all([t, f])


@query("I2_distinct", ("ticks",), "select distinct ticker, trade_date from ticks")
def _(spark, sf):
    return view(spark, sf, "ticks").select("ticker", "trade_date").distinct()


@query("I3_set_difference", ("filenames",), "select filename from filenames where file_id % 2 = 0 except all select filename from filenames where file_id % 3 = 0")
def _(spark, sf):
    f = view(spark, sf, "filenames")
    return f.where("file_id % 2 = 0").select("filename").exceptAll(f.where("file_id % 3 = 0").select("filename"))


@query("I4_set_intersection", ("wide_trades", "filenames"), "select trade_date from wide_trades intersect select cast(o_orderdate as date) from orders")
def _(spark, sf):
    days = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("trade_date"))
    return view(spark, sf, "wide_trades").select("trade_date").intersect(days)
