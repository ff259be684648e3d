"""Hot half hours and hot tickers: same rows as plain windows and joins, and no task holds them alone."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tickloom.functions import columns
from tickloom.operators import blocks, joins, paths, sweeps, trades
from tickloom.plans import models
from tickloom.session import FULL_DAY


@pytest.fixture
def plain_shuffles(spark):
    """Partitions as they were asked for, so that rows per task can be counted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def history(spark, n=8000):
    """Trades of which 90 % begin within one half hour."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), "2024-01-02" if rnd.random() < 0.95 else "2024-01-03", 36_000 + rnd.randrange(1800) if rnd.random() < 0.9 else rnd.randrange(86_400), round(rnd.uniform(-1, 1), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "trade_id long, ticker string, trade_date string, entry_sec int, pct_change double").withColumn("trade_date", F.to_date("trade_date"))


def test_ranges_spread_a_hot_half_hour(plain_shuffles):
    t = history(plain_shuffles)
    ranged = blocks.in_ranges(t, ["trade_date", "entry_sec", "trade_id"])
    sizes = [r["count"] for r in ranged.where("trade_date = '2024-01-02' and entry_sec between 36000 and 37799").groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)
    ends = ranged.groupBy("_range").agg(F.min(F.struct("trade_date", "entry_sec", "trade_id")).alias("a"), F.max(F.struct("trade_date", "entry_sec", "trade_id")).alias("b")).orderBy("_range").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_numbers_and_running_sums_equal_plain_windows(plain_shuffles):
    t = history(plain_shuffles)
    got = {r["trade_id"]: r["trade_no"] for r in trades.dense_trade_id(t).collect()}
    want = t.withColumn("x", F.row_number().over(Window.orderBy("trade_date", "entry_sec", "trade_id"))).collect()
    assert got == {r["trade_id"]: r["x"] for r in want}
    run = trades.running_percents(t)
    assert "_range" not in run.columns
    day = Window.partitionBy("trade_date").orderBy("entry_sec", "trade_id")
    one = Window.partitionBy("trade_date", "ticker").orderBy("entry_sec", "trade_id")
    for r in run.join(t.select("trade_id", F.sum("pct_change").over(day).alias("a"), F.sum("pct_change").over(one).alias("b")), "trade_id").collect():
        assert abs(r["running_all"] - r["a"]) < 0.00501 and abs(r["running_by_ticker"] - r["b"]) < 0.00501


def test_tick_gap_and_category_codes_equal_plain_windows(plain_shuffles):
    ticks = history(plain_shuffles).select("trade_date", F.col("entry_sec").alias("sec"), F.col("trade_id").alias("tick_id"), "ticker")
    w = Window.partitionBy("trade_date").orderBy("sec", "tick_id")
    want = {r["tick_id"]: r["x"] for r in ticks.withColumn("x", F.col("sec") - F.lag("sec").over(w)).collect()}
    assert {r["tick_id"]: r["gap"] for r in paths.tick_gap(ticks).collect()} == want
    names = ticks.select("tick_id", F.when(F.col("tick_id") % 50 > 0, F.concat(F.lit("n"), F.col("tick_id") % 137)).alias("name"))
    order = {v: i for i, v in enumerate(sorted({r["name"] for r in names.collect() if r["name"]}))}
    for r in columns.category_codes(names, "name", "code").collect():
        assert r["code"] == (order[r["name"]] if r["name"] else -1)


def test_folds_are_even_in_every_class(plain_shuffles):
    t = history(plain_shuffles).withColumn("label", (F.col("pct_change") > 0.8).cast("int"))
    counts = models.stratified_folds(t, 4).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in counts if r["label"] == label]
        assert len(n) == 4 and max(n) - min(n) <= 1


def hot_ticks(spark, n=6000):
    rnd = random.Random(6)
    ticks = [(i, "hot" if i % 10 else rnd.choice(["a", "b", None]), "d1", rnd.randrange(1000), 1.0 * i) for i in range(n)]
    some = [(1, "hot", "d1"), (2, "hot", "d1"), (3, "a", "d1"), (4, "b", "d2"), (5, None, "d1"), (1, "hot", "d1")]
    return spark.createDataFrame(some, "trade_id long, ticker string, trade_date string"), spark.createDataFrame(ticks, "tick_id long, ticker string, trade_date string, sec int, price double")


def test_a_hot_ticker_day_spreads_over_tasks(plain_shuffles):
    plain_shuffles.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t, k = hot_ticks(plain_shuffles)
        want = t.join(k, ["ticker", "trade_date"])
        got = joins.equi_join(t, k, most=300)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        per_task = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert max(per_task(want)) > 0.9 * want.count()
        assert len(per_task(got)) >= 6 and max(per_task(got)) < 0.4 * want.count()
        # nothing is hot: the plain join; no ticks at all: no rows
        assert sorted(map(repr, joins.equi_join(t, k).collect())) == sorted(map(repr, want.collect()))
        assert joins.equi_join(t, k.limit(0), most=1).collect() == []
    finally:
        plain_shuffles.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tick_bounds_equal_two_lookups(spark):
    rnd = random.Random(8)
    trades_ = [(i, rnd.choice("ab"), "d1", s := rnd.randrange(4000), s + rnd.randrange(-50, 900)) for i in range(60)] + [(100, "c", "d1", 5, 9), (0, "a", "d1", 10, 20), (0, "a", "d1", 10, 20)]
    ticks = [(i, rnd.choice("ab"), "d1", rnd.randrange(300, 4500), float(i)) for i in range(400)]
    t = spark.createDataFrame(trades_, "trade_id long, ticker string, trade_date string, entry_sec int, exit_sec int")
    k = spark.createDataFrame(ticks, "tick_id long, ticker string, trade_date string, sec int, price double")
    want = []
    for i, ticker, d, a, b in trades_:
        mine = sorted((sec, tick, p) for tick, x, day, sec, p in ticks if x == ticker and day == d)
        start, end = next((x for x in mine if x[0] >= a), None), next((x for x in reversed(mine) if x[0] <= b), None)
        want.append((i, ticker, start, end, start is not None and end is not None and start[:2] <= end[:2]))
    got = [(r["trade_id"], r["ticker"], r["start_tick"] and tuple(r["start_tick"]), r["end_tick"] and tuple(r["end_tick"]), r["valid"]) for r in joins.tick_bounds(t, k).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_an_interval_join_never_broadcasts_repeated_trades(spark):
    """Trades are repeated per half hour after Spark's size check, so a few MB of them became many times that in the driver."""
    t = spark.createDataFrame([(1, "a", "d", 10), (2, "a", "d", 50_000)], "trade_id long, ticker string, trade_date string, entry_sec int")
    k = spark.createDataFrame([("a", "d", s, s) for s in range(0, 86_400, 7_000)], "ticker string, trade_date string, sec int, tick_id long")
    out = joins.open_interval_join(t, k, F.col("entry_sec"), FULL_DAY)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.trade_id, r.sec) for r in out.collect()) == sorted((i, s) for i, e in ((1, 10), (2, 50_000)) for s in range(0, 86_400, 7_000) if s >= e)


def odd_market(spark, n=400, seed=7):
    """Trades (ids and entries repeat, some prices are null) and ticks of three days, some NaN or null, several a second."""
    rnd = random.Random(seed)
    day = lambda: rnd.choice(("2024-01-02", "2024-01-03", "2024-01-04"))
    trades_ = [(rnd.randrange(n // 2) if rnd.random() < 0.9 else None, rnd.choice("ab"), day(), rnd.choice(("buy", "short")), rnd.randrange(86_400), 86_400, None if rnd.random() < 0.05 else round(rnd.uniform(99.5, 100.5), 2)) for _ in range(n)]
    ticks_ = [(rnd.choice("ab"), day(), rnd.randrange(86_400) // 3 * 3, i, rnd.choice([None, float("nan")]) if rnd.random() < 0.03 else round(rnd.gauss(100, 0.15), 3)) for i in range(6000)]
    t = spark.createDataFrame(trades_, "trade_id long, ticker string, trade_date string, side string, entry_sec int, exit_sec int, entry_price double")
    return t, spark.createDataFrame(ticks_, "ticker string, trade_date string, sec int, tick_id long, price double")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_race_needs_only_the_path_to_its_first_sure_hit(spark):
    t, k = odd_market(spark)
    whole, cut = paths.roi_path(t, k, FULL_DAY), paths.roi_path(t, k, FULL_DAY, over=sweeps.race_over(0.4, -0.3))
    assert rows_of(sweeps.scalp_race(cut, 0.4, -0.3)) == rows_of(sweeps.scalp_race(whole, 0.4, -0.3))
    assert cut.count() < whole.count() / 8


def test_a_stop_state_path_needs_only_the_path_to_its_first_sure_stop(spark):
    t, k = odd_market(spark, seed=8)
    t = t.withColumn("trade_id", F.xxhash64(*t.columns))  # rows of one trade have an order
    whole, cut = paths.roi_path(t, k, FULL_DAY), paths.roi_path(t, k, FULL_DAY, over=paths.at_stop())
    names = ("trade_id", "side", "entry_price", "sec", "tick_id", "roi", "armed", "stopped")
    assert rows_of(paths.stop_state_path(cut).select(*names)) == rows_of(paths.stop_state_path(whole).select(*names))
    assert cut.count() < whole.count()


def test_a_join_with_many_rows_from_few_is_dealt_to_more_tasks(spark):
    """Spark sizes its tasks by what they read; here a few kB make many rows, all in one task before."""
    t = spark.createDataFrame([(i, "ab"[i % 2], "d") for i in range(300)] + [(-1, None, "d")], "trade_id long, ticker string, trade_date string").hint("merge")
    k = spark.createDataFrame([("abc"[i % 3], "d", i, i) for i in range(900)] + [(None, "d", 1, -1)], "ticker string, trade_date string, sec int, tick_id long")
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    plain, dealt = t.join(k, ["ticker", "trade_date"]), joins.equi_join(t, k, pairs=5000)
    assert tasks(plain) == 1 and tasks(dealt) >= 6
    assert dealt.columns == plain.columns and rows_of(dealt) == rows_of(plain)
    assert joins.equi_join(t.limit(0), k, pairs=1).collect() == []


def test_an_open_interval_join_repeats_no_trade(spark):
    t, k = odd_market(spark, 120)
    out = joins.open_interval_join(t, k, F.col("entry_sec"), FULL_DAY)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    buckets = joins.interval_join(t, k, F.col("entry_sec"), F.lit(86_400))
    assert out.columns == buckets.columns and rows_of(out) == rows_of(buckets)
