"""Hand-worked cases of the operators with subtle rules."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.functions import clock, columns
from tickloom.functions.numbers import roi, round_to
from tickloom.operators import joins, paths, stats, sweeps, trades, validate
from tickloom.session import FULL_DAY
from tickloom.sources import files, tables

DAY = dt.date(2025, 9, 22)
TICK = "ticker string, trade_date date, sec int, tick_id bigint, price double"
TRADE = "trade_id bigint, ticker string, trade_date date, side string, entry_sec int, exit_sec int, entry_price double"


def ticks(spark, prices, start=100, ticker="A"):
    return spark.createDataFrame([(ticker, DAY, start + i, i, float(p)) for i, p in enumerate(prices)], TICK)


def trade(spark, entry=100, exit_=10_000, price=100.0, side="buy", tid=1, ticker="A"):
    return spark.createDataFrame([(tid, ticker, DAY, side, entry, exit_, price)], TRADE)


def fills(spark, rows, ticker="A"):
    return spark.createDataFrame([(ticker, DAY, s, i, float(p), q) for i, (s, q, p) in enumerate(rows)], "ticker string, trade_date date, sec int, fill_id bigint, net_price double, qty int")


def test_round_is_numpy_round(spark):
    v = [2.675, 0.125, 1.005, -0.001, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(round_to("x", 2)).collect()]
    import numpy as np
    assert got == [float(np.round(x, 2)) + 0.0 for x in v]
    assert str(got[3]) == "0.0"


def test_unknown_side_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(roi(F.lit(1.0), F.lit(2.0), F.lit("hold"))).collect()


def test_episode_through_zero_and_never_flat(spark):
    # +2, -4 passes through zero, +2 returns to it: one episode. The last fill never gets flat.
    f = fills(spark, [(1, 2, 10), (2, -4, 11), (3, 2, 9), (4, 5, 8)])
    rows = trades.round_trips(trades.position_episodes(f)).collect()
    assert len(rows) == 1
    r = rows[0]
    # second fill closes with the long side: (11-10)*4; third with the short side: (10-9)*2
    assert (r.side, r.entry_sec, r.exit_sec, r.dollar_change, r.investment, r.pct_change) == ("buy", 1, 3, 6.0, 20.0, 30.0)


def test_episode_ties_use_fill_order(spark):
    f = fills(spark, [(5, 1, 10), (5, -1, 12), (5, -1, 12), (5, 1, 11)])
    rows = sorted(trades.round_trips(trades.position_episodes(f)).collect(), key=lambda r: r.ep)
    assert [(r.side, r.dollar_change) for r in rows] == [("buy", 2.0), ("short", 1.0)]


def test_stop_state_adjacent_rows(spark):
    # +0.6 arms the trailing stop for later rows only; the row at 0.0 right after it stops
    p = paths.roi_path(trade(spark), ticks(spark, [100, 100.6, 100.0, 101]), FULL_DAY)
    rows = paths.stop_state_path(p).orderBy("sec").collect()
    assert [(r.roi, r.armed, r.stopped) for r in rows] == [(0.0, 0, 0), (0.6, 0, 0), (0.0, 1, 1)]


def test_stop_state_initial_stop(spark):
    p = paths.roi_path(trade(spark), ticks(spark, [100, 99.6, 100.6]), FULL_DAY)
    assert [r.roi for r in paths.stop_state_path(p).orderBy("sec").collect()] == [0.0, -0.4]


def test_ladder_fills_over_zero(spark):
    p = paths.trade_path(trade(spark), ticks(spark, [100, 100.25, 100.25, 99.78]))
    assert [r.rung for r in paths.price_ladder(p).orderBy("pos").collect()] == [0, 1, 2, 1, 0, -1, -2]
    assert paths.ladder_text(paths.price_ladder(p)).first().ladder == "0.0|0.1|0.2|0.1|0.0|-0.1|-0.2"


def test_ladder_gap_on_first_tick_is_not_filled(spark):
    p = paths.trade_path(trade(spark), ticks(spark, [100.55, 100.75]))
    assert [r.rung for r in paths.price_ladder(p).orderBy("pos").collect()] == [5, 6, 7]


def test_summary_row_without_tick_after_entry(spark):
    f = fills(spark, [(500, 1, 100), (510, -1, 101)])
    k = ticks(spark, [100, 100]).withColumns({c: F.lit(1.0) for c in ("atr14", "atr28")}).withColumns({c: F.lit(1) for c in ("adx28", "adx14", "adx7", "rsi")})
    r = trades.build_trade_summary(f, k).first()
    assert r.pct_change == 1.0 and r.entry_atr14 is None and r.best_pct is None and r.trade_no == 1


def test_excursions_short_and_never_improved(spark):
    x = paths.excursions(trade(spark, side="short"), ticks(spark, [100, 101, 99, 99])).first()
    assert (x.best_price, x.best_pct, x.best_sec_in_trade, x.worst_price, x.worst_pct, x.worst_sec_in_trade) == (99.0, 1.0, 2, 101.0, -1.0, 1)
    y = paths.excursions(trade(spark), ticks(spark, [100, 100])).first()
    assert (y.best_pct, y.best_sec_in_trade, y.holding_reached) == (0.0, 0, False)


def test_exit_stop_wins_tie_and_last_return(spark):
    # a jump can only reach one side; a stop above the target makes both true on one tick
    p = paths.trade_path(trade(spark), ticks(spark, [100.3]))
    assert sweeps.simulate_exit(p, (0.2,), (0.4,)).first().result == 0.4
    p = paths.trade_path(trade(spark), ticks(spark, [100, 100.1]))
    assert sweeps.simulate_exit(p, (0.2,), (-0.3,)).first().result == 0.1


def test_success_label_and_optimal_stop(spark):
    t = trade(spark, tid=1).unionByName(trade(spark, tid=2, ticker="B")).unionByName(trade(spark, tid=3, ticker="C"))
    k = ticks(spark, [100, 99.65, 100.6]).unionByName(ticks(spark, [100, 99.5, 99], ticker="B")).unionByName(ticks(spark, [100, 99.65], ticker="C"))
    p = paths.roi_path(t, k, FULL_DAY).withColumn("vol", F.lit(0.5))
    assert {r.trade_id: r.label for r in sweeps.success_label(p).collect()} == {1: 1, 2: 0, 3: None}
    # trade 1 survives -0.4 but not -0.3; trade 2 is stopped everywhere; trade 3 reaches neither
    assert {r.trade_id: r.optimal_sl for r in sweeps.optimal_stop_loss(p, (-0.3, -0.4)).collect()} == {1: -0.4, 2: -0.3}


def test_valid_exit_set_counts():
    assert len(sweeps.valid_exit_sets(2)) == 326
    assert len(sweeps.valid_exit_sets(3)) == 7734
    assert len(sweeps.valid_two_target_sets()) == 1505
    assert len(sweeps.STOP_CANDIDATES) == 6


def test_nearest_tick_crosses_empty_blocks(spark):
    k = ticks(spark, [1], start=10).unionByName(ticks(spark, [2], start=50_000))
    t = trade(spark, entry=20, exit_=40_000)
    assert joins.asof_forward(t, k).first().tick.sec == 50_000
    assert joins.asof_backward(t, k).first().tick.sec == 10
    assert joins.asof_forward(trade(spark, entry=60_000), k).first().tick is None


def test_interval_bounds_are_inclusive(spark):
    k = ticks(spark, [1, 2, 3, 4], start=1798)
    rows = joins.interval_join(trade(spark, entry=1799, exit_=1800), k, F.col("entry_sec"), F.col("exit_sec")).collect()
    assert sorted(r.sec for r in rows) == [1799, 1800]


def test_required_values_all_null_column(spark):
    df = spark.createDataFrame([("f", i, None, "x") for i in range(2, 10)], "filename string, line bigint, a string, b string")
    r = validate.check_required_values(df, ("a", "b")).first()
    assert (r.missing_a, r.missing_b, r.first_lines) == (8, 0, "2,3,4,5,6")


def test_gap_waiver_and_strict_gap(spark):
    df = spark.createDataFrame([("f", 2, 10), ("f", 3, 17), ("f", 4, 18), ("f", 5, 30)], "filename string, line bigint, sec int")
    gaps = validate.check_time_gaps(df, 7)
    assert sorted((r.line, r.gap) for r in gaps.collect()) == [(3, 7), (5, 12)]
    waived = validate.apply_waivers(gaps, spark.createDataFrame([("f", 3)], "filename string, line bigint"))
    assert [r.line for r in waived.collect()] == [5]
    with pytest.raises(PySparkException):
        validate.assert_no_gap(df, 6).collect()


def test_file_names(spark):
    names = ["Raw_Market_Data_6-24-25.csv", "06-24-2025_Raw_Market_Data.csv", "notes.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", validate.normalize_tick_filename(F.col("n")).alias("r"))
    assert {r.n: (r.r.status, r.r.filename) for r in df.collect()} == {
        names[0]: ("changed", names[1]), names[1]: ("ok", names[1]), names[2]: ("bad", None)
    }
    cases = {
        "08-25-2025-TradeActivity.csv": "ok", "8-5-2025-TradeActivity_On_Demand.csv": "changed", "08-25-2025.csv": "changed",
        "2025-08-25-TradeActivity.csv": "changed", "13-25-2025-TradeActivity.csv": "bad", "8-5-2025.csv": "bad", "x.txt": "bad",
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string").select("n", validate.normalize_trade_filename(F.col("n"))["status"].alias("s"))
    assert {r.n: r.s for r in df.collect()} == cases


REPORT = """Today's Trade Activity

Working Orders
,Time Placed,Spread

Filled Orders
{c}Exec Time,Spread,Side,Qty,Pos Effect,Symbol,Exp,Strike,Type,Price,Net Price,Price Improvement,Order Type
{c}9/22/25 07:34:23,STOCK,SELL,-4,AUTO,HOOD,,,STOCK,123.70,123.70,.00,STP
{c}09-22-2025 07:30:00,STOCK,BUY,+4,AUTO,HOOD,,,STOCK,123.10,123.10,.00,MKT
{tail}"""


@pytest.mark.parametrize("commas", ["", ",", ",,"])
@pytest.mark.parametrize("tail", ["", "\nCanceled Orders\n,1,2"])
def test_trade_report(spark, tmp_path, commas, tail):
    (tmp_path / "09-22-2025-TradeActivity.csv").write_text(REPORT.format(c=commas, tail=tail))
    (tmp_path / "nothing.csv").write_text("no block here\n")
    rows = sorted(files.read_trade_report(spark, str(tmp_path)).collect(), key=lambda r: r.line)
    assert [(r.qty, r.net_price, r.symbol, r.exec_time.hour) for r in rows] == [(-4, 123.7, "HOOD", 7), (4, 123.1, "HOOD", 7)]
    heads = files.report_headers(spark.read.text(str(tmp_path), wholetext=True).withColumn("file_name", F.col("_metadata.file_name")))
    ok = validate.check_report_columns(heads.withColumnRenamed("file_name", "filename"))
    assert {r.filename: r.ok for r in ok.collect()} == {"09-22-2025-TradeActivity.csv": True, "nothing.csv": None}


def test_tick_csv_two_forms(spark, tmp_path):
    short, long = tmp_path / "s", tmp_path / "l"
    short.mkdir(), long.mkdir()
    (short / "09-22-2025_Raw_Market_Data.csv").write_text(",".join(validate.TICK_HEADER) + "\nHOOD,1.5,0,0,,0.2,50,100,20,21,22,0.3,0.9,06:30:01\n")
    (long / "Raw_Market_Data_9-22-25.csv").write_text(",".join(validate.TICK_HEADER_WARMUP) + "\nHOOD,1.5,0,0,0.1,0.2,50,100,20,21,22,0.3,0.54,0.9,06:30:01\n")
    a = files.with_file_date(files.read_ticks_csv(spark, str(short))).first()
    b = files.with_file_date(files.read_ticks_csv(spark, str(long), warmup=True)).first()
    assert (a.atr14, a.vol_warmup, a.sec, a.trade_date) == (None, None, 23401, DAY)
    assert (b.vol_warmup, b.volatility_ratio, b.date_time) == (0.54, 0.9, dt.datetime(2025, 9, 22, 6, 30, 1))


def test_tick_csv_by_header_names(spark, tmp_path):
    heads = [validate.TICK_HEADER, validate.TICK_HEADER_WARMUP, list(reversed(validate.TICK_HEADER))]
    values = dict(zip(validate.TICK_HEADER_WARMUP, ("HOOD", "101.0", "0.5", "0.25", "0.1", "0.2", "50", "100", "20", "21", "22", "0.3", "0.54", "0.9", "06:30:01")))
    for i, head in enumerate(heads):
        (tmp_path / f"0{i + 1}-22-2025_Raw_Market_Data.csv").write_text(",".join(head) + "\n" + ",".join(values[h] for h in head) + "\n")
    rows = sorted(files.read_ticks_csv(spark, str(tmp_path)).collect(), key=lambda r: r.file_name)
    assert [(r.price, r.macd_val, r.volatility_ratio, r.vol_warmup, r.sec, r._corrupt_record) for r in rows] == [(101.0, 0.5, 0.9, w, 23401, None) for w in (None, 0.54, None)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.csv").write_text(",".join(validate.TICK_HEADER) + "\n" + "HOOD,x\n" + ",".join(["HOOD"] + ["1"] * 12 + ["06:30:01", "more"]) + "\n")
    assert [r._corrupt_record is not None for r in files.read_ticks_csv(spark, str(bad)).select("_corrupt_record").collect()] == [True, True]
    (bad / "y.csv").write_text("Ticker,Cost\nHOOD,1\n")
    with pytest.raises(PySparkException):
        files.read_ticks_csv(spark, str(bad)).collect()
    with pytest.raises(PySparkException):
        files.read_ticks_csv(spark, str(tmp_path), warmup=True).collect()


def test_stored_insert_and_upsert_keep_partitions(spark, tmp_path):
    path = str(tmp_path / "ticks")
    schema = "ticker string, trade_date date, sec int, seq int"
    day = lambda n: dt.date(2025, 9, n)
    tables.write_ticks(spark.createDataFrame([("A", day(1), 5, 1), ("A", day(2), 5, 1), ("B", day(2), 6, 1)], schema), path)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "ticks" / "trade_date=2025-09-01").iterdir()}
    tables.append_absent(spark, path, spark.createDataFrame([("A", day(2), 5, 9), ("A", day(3), 7, 9)], schema), tables.TICK_KEYS, "seq")
    tables.upsert_stored(spark, path, spark.createDataFrame([("A", day(2), 5, 2), ("C", day(4), 1, 2)], schema), tables.TICK_KEYS)
    rows = sorted((r.ticker, r.trade_date.day, r.sec, r.seq) for r in spark.read.parquet(path).collect())
    assert rows == [("A", 1, 5, 1), ("A", 2, 5, 2), ("A", 3, 7, 9), ("B", 2, 6, 1), ("C", 4, 1, 2)]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "ticks" / "trade_date=2025-09-01").iterdir()} == untouched
    with pytest.raises(ValueError):
        tables.append_absent(spark, path, spark.createDataFrame([("A", 1, 1)], "ticker string, sec int, seq int"), ["ticker", "sec"], "seq")


def test_clock(spark):
    df = spark.createDataFrame([("6:30:00",), ("24:00:00",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(clock.hms_to_sec(F.col("t"))).collect()] == [23400, None, None, None]
    half = spark.createDataFrame([(23430,), (23490,)], "s int").select(clock.minutes_since_open(F.col("s")))
    assert [r[0] for r in half.collect()] == [0, 2]  # half to even
    d = spark.createDataFrame([("8/9/25",), ("13-40-2025",)], "t string").select(clock.normalize_date_text(F.col("t")))
    assert [r[0] for r in d.collect()] == ["08-09-2025", None]


def test_unmapped_target_and_missing_columns(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(columns.target_code(F.lit("1.5"))).collect()
    with pytest.raises(ValueError):
        columns.drop_leaky_columns(spark.range(1), ["x"])
    with pytest.raises(ValueError):
        validate.validate_training_input(spark.range(1), ["x"])


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([("d1", 1, "a"), ("d2", 1, "b")], "k string, seq int, v string")
    new = spark.createDataFrame([("d2", 1, "c"), ("d3", 1, "d")], "k string, seq int, v string")
    assert {r.k: r.v for r in tables.upsert_latest(old, new, ["k"]).collect()} == {"d1": "a", "d2": "c", "d3": "d"}
    diag = spark.createDataFrame([("m", "0.10")], "model_name string, v string").select("model_name", F.col("v").cast("decimal(4,2)").alias("version_id"))
    models = spark.createDataFrame([("m",), ("n",)], "model_name string")
    assert {r.model_name: str(r.version_id) for r in tables.next_model_versions(diag, models).collect()} == {"m": "0.11", "n": "0.10"}


def test_append_absent_and_route(spark, tmp_path):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, o int")
    path = str(tmp_path / "t")
    a.write.parquet(path)
    tables.append_absent(spark, path, spark.createDataFrame([(2, 7), (3, 9), (3, 8)], "k int, o int"), ["k"], "o")
    assert sorted((r.k, r.o) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 6), (3, 8)]
    routed = str(tmp_path / "r")
    files.route_by_status(a.withColumn("status", F.lit("error")), routed)
    with pytest.raises(PySparkException):
        files.route_by_status(a.withColumn("status", F.lit("error")), routed)


def test_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=500).round(2), np.full(400, 0.25), [1e6]])
    df = spark.createDataFrame([(float(x),) for x in v], "y double")
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = stats.exact_quantiles(df, "y", probs).first().q
    assert np.allclose(got, np.quantile(v, probs))


def test_pearson_p_value(spark):
    # two-sided points of Student's t at 10 and 100 degrees of freedom, and a relation beyond doubt
    points = [(2.228139, 12, 0.05), (3.169273, 12, 0.01), (1.983972, 102, 0.05), (3.390492, 102, 0.001), (0.0, 12, 1.0)]
    rows = [(t / (n - 2 + t * t) ** 0.5, n, p) for t, n, p in points] + [(1.0, 20, 0.0), (0.9, 1_000_000, 0.0)]
    df = spark.createDataFrame(rows, "r double, n long, want double")
    for r in df.withColumn("p", stats.pearson_p_value(F.col("r"), F.col("n"))).collect():
        assert abs(r["p"] - r["want"]) < 1e-5 * max(r["want"], 1e-3)
