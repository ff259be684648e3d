"""Families G, H and I: aggregates, ranks, top-k and set operations.

Order statistics are exact without sorting everything in one task: equal values are counted first,
then counts are accumulated over value blocks (see operators.blocks).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numbers import round_to
from tickloom.operators import blocks, joins

HOLD, FAIL = 0.6, -0.3  # fixed values: holders have best > 0.6, fails have pct < -0.3


def settle(c: Column, digits: int = 6) -> Column:
    """A sum or mean of doubles without the noise of its summation order."""
    return round_to(c, digits)


def money(c: Column) -> Column:
    return round_to(settle(c), 2)


# ---------------------------------------------------------------- exact order statistics

def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """Distinct values with their count ``n`` and the count ``cum`` up to and including the value.

    The blocks are cut at approximate quantiles of the distinct values, so they are of similar size.
    """
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    marks = [i / parts for i in range(1, parts)]
    splits = vc.agg(F.percentile_approx(value, marks, 2000)).scalar()
    marked = vc.withColumn("_sp", splits)
    block = F.size(F.filter("_sp", lambda s: s <= F.col(value))).cast("long")
    return blocks.running_sum(marked, list(keys), block, [value], {"cum": F.col("n")}).drop("_sp")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """Linear-interpolation quantiles per group as an array column."""
    keys = list(keys)
    vc = value_counts(df, value, keys)
    totals = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    vc = vc.join(totals, keys) if keys else vc.withColumn("_n", totals.scalar())
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        aggs.append(F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"))
    g = vc.groupBy(*keys).agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(lo + (hi - lo) * (pos - F.floor(pos)))
    return g.select(*keys, F.array(*out).alias(name))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Distinct values with their average rank (ties averaged)."""
    return value_counts(df, value).select(value, (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias(out))


# ---------------------------------------------------------------- summaries of trades

def _summary_cols(pct="pct_change", dollars="dollar_change", best="best_pct") -> list[Column]:
    holder, fail = F.col(best) > HOLD, F.col(pct) < FAIL
    return [
        money(F.sum(pct)).alias("total_pct"), money(F.sum(dollars)).alias("total_dollars"),
        F.count(F.lit(1)).alias("trades"),
        F.count(F.when(holder, 1)).alias("holders"), money(F.coalesce(F.sum(F.when(holder, F.col(pct))), F.lit(0.0))).alias("holder_pct"),
        F.count(F.when(fail, 1)).alias("fails"), money(F.coalesce(F.sum(F.when(fail, F.col(pct))), F.lit(0.0))).alias("fail_pct"),
    ]


def day_summary(trades: DataFrame) -> DataFrame:
    """G1."""
    return trades.groupBy("trade_date").agg(*_summary_cols())


def ticker_day_summary(trades: DataFrame) -> DataFrame:
    """G2."""
    return trades.groupBy("trade_date", "ticker").agg(*_summary_cols())


def overall_summary(trades: DataFrame) -> DataFrame:
    """Totals over all days, overall (ticker null) and per ticker, and the same per trading day."""
    days = trades.agg(F.countDistinct("trade_date")).scalar()
    g = trades.groupingSets([[], ["ticker"]], "ticker").agg(*_summary_cols()).withColumn("days", days)
    per_day = [round_to(F.col(c) / F.col("days"), 2).alias(f"{c}_per_day") for c in ("total_pct", "holder_pct", "fail_pct")]
    return g.select("*", *per_day)


def red_green_days(results: DataFrame, value: str = "roi", positions: int = 6) -> DataFrame:
    """Days whose sum is below 0 and the others: count and mean / positions."""
    days = results.groupBy("trade_date").agg(settle(F.sum(value)).alias("_s"))
    red = F.col("_s") < 0
    mean = lambda cond: round_to(settle(F.coalesce(F.avg(F.when(cond, F.col("_s"))), F.lit(0.0)) / positions), 2)
    return days.agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(red, 1)).alias("red_days"), F.count(F.when(~red, 1)).alias("green_days"),
        mean(red).alias("avg_red_day"), mean(~red).alias("avg_green_day"),
    )


HOLD_VALUES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # fixed values


def holding_outcomes(path: DataFrame, holds: Sequence[float] = HOLD_VALUES, hold_sl: float = 0.0, sl: float = -0.4) -> DataFrame:
    """Last return of every trade under every holding value, without one path per value.

    Each row knows the first later row with roi <= hold_sl; the row that arms a holding value therefore
    knows its stop. The path ends at that row or at the first roi <= sl, whichever is earlier.
    """
    at = F.struct("sec", "tick_id", "roi")
    # later rows, as a growing frame in reverse order
    ahead = Window.partitionBy("trade_id").orderBy(F.desc("sec"), F.desc("tick_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = path.withColumn("_next", F.min(F.when(F.col("roi") <= hold_sl, at)).over(ahead))
    keep = [c for c in ("ticker", "trade_date", "entry_sec") if c in path.columns]
    g = rows.groupBy("trade_id", *keep).agg(
        F.min(F.when(F.col("roi") <= sl, at)).alias("_sl"), F.max(at).alias("_last"),
        *[F.min_by("_next", F.when(F.col("roi") >= h, at)).alias(f"_h{i}") for i, h in enumerate(holds)],
    )
    items = F.array(*[
        F.struct(F.lit(h).alias("hold"), F.coalesce(F.least("_sl", f"_h{i}"), F.col("_last"))["roi"].alias("final_roi")) for i, h in enumerate(holds)
    ])
    return g.select("trade_id", *keep, F.explode(items).alias("x")).select("trade_id", *keep, "x.*")


def holding_value_sweep(outcomes: DataFrame, by: Sequence[str] = ("hold",)) -> DataFrame:
    """Trades that reached the holding value and total return, overall, by ticker and by date."""
    by = list(by)
    reached = (F.col("final_roi") >= F.col("hold")) | ((F.col("final_roi") < 0.1) & (F.col("final_roi") > -0.1))
    sets = [by, [*by, "ticker"], [*by, "trade_date"]]
    return outcomes.withColumn("_r", reached.cast("long")).groupingSets(sets, *by, "ticker", "trade_date").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("_r").alias("reached"), money(F.sum("final_roi")).alias("total_roi")
    )


def entry_bucket_roi(results: DataFrame, open_minute: int = 390, size: int = 10, buckets: int = 6, value: str = "roi") -> DataFrame:
    """Return by ``size``-minute entry bucket; earlier entries count in the first bucket."""
    b = F.greatest(F.floor((F.floor(F.col("entry_sec") / 60) - open_minute) / size), F.lit(0)).cast("int")
    return results.withColumn("bucket", b).where(F.col("bucket") < buckets).groupBy("bucket").agg(
        money(F.sum(value)).alias("roi_sum"), F.count(F.lit(1)).alias("trades")
    )


def backtest_totals(results: DataFrame, value: str = "roi", positions: int = 6) -> DataFrame:
    """Overall, by date, and by date and ticker; averages follow the rounding of the report."""
    g = results.groupingSets([[], ["trade_date"], ["trade_date", "ticker"]], "trade_date", "ticker").agg(
        F.count(F.lit(1)).alias("trades"), F.countDistinct(F.col("trade_date")).alias("days"), settle(F.sum(value)).alias("_s")
    )
    per_trade = round_to(F.col("_s") / F.col("trades"), 4)
    level = F.coalesce(F.col("days"), F.lit(1))
    per_day = round_to(F.col("_s") / level, 2)
    return g.select(
        "trade_date", "ticker", "trades", round_to("_s", 2).alias("total"), per_trade.alias("avg_per_trade"),
        round_to(per_trade / positions, 4).alias("avg_per_trade_6"), per_day.alias("avg_per_day"), round_to(per_day / positions, 2).alias("avg_per_day_6"),
    )


def trade_test(results: DataFrame, value: str = "roi", positions: int = 6) -> DataFrame:
    """The nine trade-test statistics of one model: G8's totals over all days, and G4's mean red and green day."""
    whole = backtest_totals(results, value, positions).where("trade_date is null and ticker is null")
    days = red_green_days(results, value, positions).select(F.struct("days", "avg_red_day", "avg_green_day")).scalar()
    return whole.withColumn("_d", days).select(
        "trades", F.col("total").alias("overall_roi_total"), F.col("_d.days").alias("days"), "avg_per_trade", F.col("avg_per_trade_6").alias("avg_per_trade_divided_by_6"),
        F.col("avg_per_day").alias("overall_avg_per_day_BAD_METRIC"), F.col("avg_per_day_6").alias("overall_avg_per_day_divided_by_6_BAD_METRIC"), "_d.avg_red_day", "_d.avg_green_day",
    )


# ---------------------------------------------------------------- model diagnostics

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)  # fixed values


def response_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """G9."""
    q = exact_quantiles(df, y, [p / 100 for p in PERCENTILES]).select("q").scalar()
    c = F.col(y)
    share = lambda cond: settle(F.avg(cond.cast("double")))
    g = df.agg(
        F.count(y).alias("count"), settle(F.min(y)).alias("min"), settle(F.max(y)).alias("max"), settle(F.avg(y)).alias("mean"),
        settle(F.stddev_pop(y)).alias("std"), settle(F.skewness(y)).alias("skew"), settle(F.kurtosis(y)).alias("kurtosis"),
        share(c < 0).alias("share_negative"), share(c >= 0.6).alias("share_holding"), share((c >= 0) & (c < 0.1)).alias("share_small"),
    ).withColumn("_q", q)
    return g.select("*", *[settle(F.col("_q")[i]).alias(f"p{p}") for i, p in enumerate(PERCENTILES)]).drop("_q")


def residual_diagnostics(df: DataFrame, y: str = "y", fitted: str = "y_hat", trade: str = "trade_id") -> DataFrame:
    """Residual statistics, correlation with the fitted values and the variance ratio of the halves
    below and above the median fitted value."""
    r = df.withColumn("_r", F.col(y) - F.col(fitted))
    median = exact_quantiles(df, fitted, [0.5]).select(F.col("q")[0]).scalar()
    low = F.col(fitted) <= median
    v1, v2 = F.var_pop(F.when(low, F.col("_r"))), F.var_pop(F.when(~low, F.col("_r")))
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(trade).alias("trades"), settle(F.avg("_r")).alias("mean_residual"),
        settle(F.stddev_pop("_r")).alias("std_residual"), settle(F.min("_r")).alias("min_residual"), settle(F.max("_r")).alias("max_residual"),
        settle(F.corr(fitted, "_r")).alias("corr_fitted_residual"), settle(F.try_divide(F.greatest(v1, v2), F.least(v1, v2))).alias("variance_ratio"),
    )


def residual_diagnostics_per_trade(df: DataFrame, y: str = "y", fitted: str = "y_hat", trade: str = "trade_id") -> DataFrame:
    """G11."""
    means = df.groupBy(trade).agg(settle(F.avg(F.col(y) - F.col(fitted)), 9).alias("_res"), settle(F.avg(fitted), 9).alias(fitted))
    return residual_diagnostics(means.withColumn(y, F.col(fitted) + F.col("_res")), y, fitted, trade)


def group_weights(df: DataFrame, trade: str = "trade_id") -> DataFrame:
    """1 / number of samples of the same trade, from one count per trade joined back."""
    n = df.groupBy(trade).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, trade).withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def smearing_factor(df: DataFrame, y: str = "y", fitted: str = "y_hat", weight: str = "weight") -> DataFrame:
    """G12."""
    w = F.col(weight)
    return df.agg(settle(F.sum(w * F.exp(F.col(y) - F.col(fitted))) / F.sum(w)).alias("smearing"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """N / (2 * n_class), one row per class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(F.col(label).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return g.where(F.col(label).isNotNull()).withColumn("weight", settle(total / (F.lit(2.0) * F.col("n"))))


def strat_labels(df: DataFrame, y: str = "y", bins: int = 10) -> DataFrame:
    """Quantile bins with repeated edges removed; two bins at the median if fewer than 3 edges remain."""
    q = exact_quantiles(df, y, [i / bins for i in range(bins + 1)])
    edges = F.array_sort(F.array_distinct("q"))
    inner = F.when(F.size(edges) >= 3, F.slice(edges, F.lit(2), F.size(edges) - 2)).otherwise(F.array(F.col("q")[bins // 2]))
    marked = df.withColumn("_e", q.select(inner.alias("e")).scalar())
    return marked.withColumn("label", F.size(F.filter("_e", lambda e: F.col(y) >= e))).drop("_e")


# ---------------------------------------------------------------- durations

def duration_window_stats(trades: DataFrame, starts: Sequence[int], size: int = 600, result: str | None = None) -> DataFrame:
    """Per listed entry window (and result value): n, mean and median duration in minutes."""
    w = F.lit(None).cast("int")
    for s in starts:
        w = F.when(F.col("entry_sec").between(s, s + size - 1), F.lit(s)).otherwise(w)
    rows = trades.withColumn("window_start", w).where("window_start is not null")
    keys = ["window_start"] + ([result] if result else [])
    med = exact_quantiles(rows, "duration_sec", [0.5], keys)
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), settle(F.avg("duration_sec") / 60.0).alias("avg_minutes"))
    return g.join(med, keys).select(*keys, "n", "avg_minutes", settle(F.col("q")[0] / 60.0).alias("median_minutes"))


def result_score(result: Column) -> Column:
    # fixed values: ordinal score of a result
    return (
        F.when(result == 0.9, 3).when(result > 0, 2).when(result == 0, 1).when(result >= -0.3, -1).when(result >= -0.5, -2)
        .when(result.isNotNull(), -3)
    )


def ordinal_result_corr(trades: DataFrame, result: str = "pct_change") -> DataFrame:
    """Correlation of the ordinal result with the duration, with its t statistic and two-sided p value when n > 10."""
    rows = trades.withColumn("_s", result_score(F.col(result)).cast("double")).where("_s is not null")
    g = rows.agg(F.count(F.lit(1)).alias("n"), settle(F.corr(F.col("duration_sec").cast("double"), F.col("_s"))).alias("r"))
    t = settle(F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(F.lit(1.0) - F.col("r") * F.col("r"))))
    enough = F.col("n") > 10
    return g.withColumn("t", F.when(enough, t)).withColumn("p", F.when(enough, settle(pearson_p_value(F.col("r"), F.col("n")))))


PANELS, WIDTHS = 2000, 12.0  # panels of the integrals below, and their reach in standard widths


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation of ``n`` pairs.

    Without a relation r has the density (1 - r**2)**((n - 4) / 2) up to a factor, so p is the share of its integral beyond abs(r). Both
    integrals are Simpson sums over twelve standard widths 1 / sqrt(n - 2), beyond which the density is below 1e-30 of its start.
    """
    power, width = (n - 4.0) / 2.0, F.lit(WIDTHS) / F.sqrt(n - 2.0)

    def area(start: Column) -> Column:
        step = (F.least(F.lit(1.0), start + width) - start) / PANELS
        at = lambda i: F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - (start + step * i) * (start + step * i)), power)
        weight = lambda i: F.when(i.isin(0, PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), lambda total, i: total + weight(i) * at(i))

    return area(F.abs(r)) / area(F.lit(0.0))


DURATION_MINUTES = (0, 2, 5, 10, 15, 30, 1e9)  # fixed values: last band is open


def duration_buckets(trades: DataFrame, result: str = "pct_change", win: float = 0.9) -> DataFrame:
    """G18."""
    band = joins.band_of(F.col("duration_sec") / 60.0, DURATION_MINUTES)
    pct = lambda cond: round_to(F.avg(cond.cast("double")) * 100.0, 2)
    return trades.withColumn("bucket", band).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), pct(F.col(result) == win).alias("win_pct"), pct(F.col(result) < 0).alias("loss_pct")
    )


# ---------------------------------------------------------------- association between columns

def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs in one aggregate over complete rows."""
    rows = df.dropna(subset=list(cols))
    pairs = list(combinations(cols, 2))
    g = rows.agg(*[settle(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return g.select(F.explode(items).alias("x")).select("x.*")


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of average ranks. Equal value tuples are counted first, so a value shared by
    many rows travels once."""
    rows = df.dropna(subset=list(cols)).select(*cols)
    tuples = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    for c in cols:
        tuples = tuples.join(average_ranks(rows, c, f"_r_{c}"), c)
    w = F.col("_c").cast("double")
    stats = [F.sum(w).alias("_n")]
    for c in cols:
        r = F.col(f"_r_{c}")
        stats += [F.sum(w * r).alias(f"_s_{c}"), F.sum(w * r * r).alias(f"_q_{c}")]
    pairs = list(combinations(cols, 2))
    for a, b in pairs:
        stats.append(F.sum(w * F.col(f"_r_{a}") * F.col(f"_r_{b}")).alias(f"_x_{a}_{b}"))
    g, n = tuples.agg(*stats), F.col("_n")

    def var(c: str) -> Column:
        return F.col(f"_q_{c}") / n - (F.col(f"_s_{c}") / n) ** 2

    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), settle(
            F.try_divide(F.col(f"_x_{a}_{b}") / n - F.col(f"_s_{a}") / n * F.col(f"_s_{b}") / n, F.sqrt(var(a) * var(b)))
        ).alias("rho")) for a, b in pairs
    ]
    return g.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """Plug-in mutual information of rank bins (ties share a bin)."""
    rows = df.dropna(subset=[x, y]).select(x, y)
    total = rows.agg(F.count(F.lit(1)).cast("double")).scalar()

    def binned(c: str, out: str) -> DataFrame:
        lowest = F.col("cum") - F.col("n")  # rows below the value
        return value_counts(rows, c).select(c, F.floor(lowest * bins / total).cast("int").alias(out))

    pairs = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("_c")).join(binned(x, "_bx"), x).join(binned(y, "_by"), y)
    cells = pairs.groupBy("_bx", "_by").agg((F.sum("_c") / total).alias("_p"))  # at most bins * bins rows
    px = cells.groupBy("_bx").agg(F.sum("_p").alias("_px"))
    py = cells.groupBy("_by").agg(F.sum("_p").alias("_py"))
    j = cells.join(px, "_bx").join(py, "_by")
    return j.agg(settle(F.sum(F.col("_p") * F.log(F.col("_p") / (F.col("_px") * F.col("_py"))))).alias("mi"))


# ---------------------------------------------------------------- classification and regression

def success_rate_by(df: DataFrame, bands: dict[str, Column], success: Column) -> DataFrame:
    """Success share and n for several groupings, in one pass over (name, band)."""
    items = F.array(*[F.struct(F.lit(k).alias("grouping"), v.cast("string").alias("band")) for k, v in bands.items()])
    return df.withColumn("_s", success.cast("double")).select("_s", F.explode(items).alias("x")).groupBy("x.grouping", "x.band").agg(
        F.count(F.lit(1)).alias("n"), settle(F.avg("_s")).alias("success_share")
    )


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class and weighted precision, recall and F1, and accuracy (class 'all')."""
    c = confusion(df, label, pred).select(F.col(label).alias("l"), F.col(pred).alias("p"), "n")
    rows = c.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("x")).select("x.*")
    zero = F.lit(0.0)
    per = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    per = per.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
    per = per.withColumn("f1", F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")), zero))
    s = F.sum("support")
    weighted = lambda m: settle(F.sum(F.col(m) * F.col("support")) / s).alias(m)
    overall = per.agg(F.lit("all").alias("class"), s.alias("support"), weighted("precision"), weighted("recall"), weighted("f1"), settle(F.sum("tp") / s).alias("accuracy"))
    classes = per.select(F.col("class").cast("string").alias("class"), "support", *[settle(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], F.lit(None).cast("double").alias("accuracy"))
    return classes.unionByName(overall)


def regression_metrics(df: DataFrame, y: str = "y", fitted: str = "y_hat", weight: Column | None = None) -> DataFrame:
    """RMSE, MAE, R2, optionally weighted."""
    w = F.lit(1.0) if weight is None else weight
    e = F.col(y) - F.col(fitted)
    g = df.withColumn("_w", w).agg(
        F.sum("_w").alias("_n"), F.sum(F.col("_w") * e * e).alias("_se"), F.sum(F.col("_w") * F.abs(e)).alias("_ae"),
        F.sum(F.col("_w") * F.col(y)).alias("_y"), F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("_yy"),
    )
    n = F.col("_n")
    return g.select(
        settle(F.sqrt(F.col("_se") / n)).alias("rmse"), settle(F.col("_ae") / n).alias("mae"),
        settle(F.lit(1.0) - F.try_divide(F.col("_se"), F.col("_yy") - F.col("_y") * F.col("_y") / n)).alias("r2"),
    )


def probability_metrics(df: DataFrame, label: str = "label", prob: str = "prob", eps: float = 1e-15) -> DataFrame:
    """Brier score, binomial deviance (2 x log loss) and ROC AUC from average ranks of the scores."""
    per = df.groupBy(prob).agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    ranks = average_ranks(df, prob, "_rank")
    g = per.join(ranks, prob)
    p = F.greatest(F.least(F.col(prob), F.lit(1 - eps)), F.lit(eps))
    pos, neg = F.col("_pos"), F.col("_n") - F.col("_pos")
    g = g.agg(
        F.sum(pos).alias("_p"), F.sum(neg).alias("_q"), F.sum(pos * F.col("_rank")).alias("_r"),
        F.sum(pos * (F.lit(1.0) - F.col(prob)) ** 2 + neg * F.col(prob) ** 2).alias("_b"),
        F.sum(-(pos * F.log(p) + neg * F.log(F.lit(1.0) - p))).alias("_l"),
    )
    n = F.col("_p") + F.col("_q")
    return g.select(
        n.alias("n"), settle(F.col("_b") / n).alias("brier"), settle(F.col("_l") * 2.0 / n).alias("deviance"),
        settle(F.try_divide(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2.0, (F.col("_p") * F.col("_q")).cast("double"))).alias("auc"),
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """G26."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", round_to(F.col("n") / total * 100.0, 2))


def confidence_stats(df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
    """Mean, min and max of the winning probability, overall (pred null) and per predicted class."""
    best = F.greatest(F.col(prob), F.lit(1.0) - F.col(prob))
    return df.withColumn("_c", best).groupingSets([[], [pred]], pred).agg(
        F.count(F.lit(1)).alias("n"), settle(F.avg("_c")).alias("mean_conf"), settle(F.min("_c")).alias("min_conf"), settle(F.max("_c")).alias("max_conf")
    )


def feature_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G28."""
    g = df.agg(*[F.min(F.col(c).cast("double")).alias(f"_a{i}") for i, c in enumerate(cols)], *[F.max(F.col(c).cast("double")).alias(f"_b{i}") for i, c in enumerate(cols)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("lo"), F.col(f"_b{i}").alias("hi")) for i, c in enumerate(cols)])).alias("x")).select("x.*")


def ticker_frequency(trades: DataFrame, k: int = 5) -> DataFrame:
    """Number of tickers and the k most frequent."""
    g = trades.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    tickers = trades.agg(F.countDistinct("ticker")).scalar()
    return g.orderBy(F.desc("n"), "ticker").limit(k).withColumn("tickers", tickers)


def attribution_summary(ranked: DataFrame) -> DataFrame:
    """Sum of contributions and mean rank per class and feature."""
    return ranked.groupBy("class", "feature").agg(settle(F.sum("contribution")).alias("contribution"), settle(F.avg("rank")).alias("avg_rank"))


def density_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 10) -> DataFrame:
    """Counts on a bins x bins grid (bins 1..n inside the range, 0 and n+1 outside)."""
    b = lambda c, r: F.width_bucket(F.col(c).cast("double"), F.lit(float(r[0])), F.lit(float(r[1])), F.lit(bins)).cast("int")
    return df.groupBy(b(x, x_range).alias("x_bin"), b(y, y_range).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- order, top-k, sets

def top_k(df: DataFrame, by: str, tie: Sequence[str], k: int = 10) -> DataFrame:
    """H1."""
    return df.orderBy(F.desc(by), *tie).limit(k)


def top_k_per(df: DataFrame, group: str, by: str, tie: Sequence[str], k: int = 10) -> DataFrame:
    """H2: the rank filter prunes inside each task before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax(df: DataFrame, value: str, item: str, lowest: bool = False) -> DataFrame:
    """H4: the item with the best value; ties go to the smaller item."""
    key = F.struct(value, item)
    best = F.min(key) if lowest else F.max(F.struct(F.col(value), -F.col(item)))
    return df.agg(best.alias("b")).select((F.col(f"b.{item}") if lowest else -F.col("b.col2")).alias(item), F.col(f"b.{value}").alias(value))


def sort_desc_time(df: DataFrame, time: str | Sequence[str], line: str) -> DataFrame:
    """H5: newest first, file order within equal times."""
    return df.orderBy(*[F.desc(t) for t in ([time] if isinstance(time, str) else time)], line)


def sort_by_column(df: DataFrame, column: str, ties: Sequence[str] = ()) -> DataFrame:
    """H6: descending, rows with equal values by ``ties``, with the column's minimum and maximum on every row."""
    ends = df.agg(F.struct(F.min(column).alias("lowest"), F.max(column).alias("highest"))).scalar()
    return df.withColumn("lowest", ends["lowest"]).withColumn("highest", ends["highest"]).orderBy(F.desc(column), *ties)


def head_n(df: DataFrame, order: Sequence[str], n: int = 21) -> DataFrame:
    """H7."""
    return df.orderBy(*order).limit(n)


def rows_by_index_range(df: DataFrame, order: DataFrame, start: int, end: int) -> DataFrame:
    """H8: source rows whose plot position lies in [start, end]; ``order`` maps position to row index."""
    return order.where(F.col("position").between(start, end)).join(df, "row_index").orderBy("position")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """I1."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
