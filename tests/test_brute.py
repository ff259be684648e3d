"""Plain Python loops, written from the operator definitions, against the Spark operators."""

import datetime as dt
import random
from itertools import product

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tickloom.operators import blocks, paths, stats, sweeps, trades
from tickloom.session import FULL_DAY

DAY = dt.date(2025, 1, 2)
TICK = "ticker string, trade_date date, sec int, tick_id bigint, price double"
TRADE = "trade_id bigint, ticker string, trade_date date, side string, entry_sec int, exit_sec int, entry_price double"
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def walks(n_trades=12, steps=60, seed=3):
    rnd = random.Random(seed)
    ticks, trade_rows = [], []
    for t in range(n_trades):
        price, side = 100.0, "buy" if t % 2 else "short"
        trade_rows.append((t, f"T{t}", DAY, side, 50, 50 + 37 * steps, 100.0))
        for i in range(steps):
            ticks.append((f"T{t}", DAY, 50 + 37 * i, t * 1000 + i, round(price, 3)))
            price += rnd.uniform(-0.25, 0.25)
    return ticks, trade_rows


def rois(ticks, row):
    sign = 1 if row[3] == "buy" else -1
    return [((p - 100.0) / 100.0 * 100 if sign == 1 else (100.0 - p) / 100.0 * 100) for k, _, _, _, p in ticks if k == row[1]]


def ladder(raw):
    out = []
    for r in raw:
        lvl = int(r * 10)
        if not out:
            out.append(lvl)
        while out[-1] != lvl:
            out.append(out[-1] + (1 if lvl > out[-1] else -1))
    return out


def race(lad, t1, s1, t2, s2):
    i = next((k for k, v in enumerate(lad) if v in (t1, s1)), None)
    if i is None:
        return lad[-1], 0
    if lad[i] == s1:
        return s1, -1
    for v in lad[i + 1:]:
        if v == s2:
            return s2, -1
        if v == t2:
            return t2, 1
    return lad[-1], 0


def frames(spark, seed=3):
    ticks, rows = walks(seed=seed)
    return ticks, rows, spark.createDataFrame(ticks, TICK), spark.createDataFrame(rows, TRADE)


def test_ladder_and_grid_search(spark):
    ticks, rows, k, t = frames(spark)
    lad = {r[0]: ladder(rois(ticks, r)) for r in rows}
    got = {}
    for r in paths.price_ladder(paths.trade_path(t, k)).collect():
        got.setdefault(r.trade_id, {})[r.pos] = r.rung
    assert {i: [v for _, v in sorted(d.items())] for i, d in got.items()} == lad

    rnd = random.Random(9)
    ent = {i: dict(vol=rnd.choice([0.1, 0.35, 0.55, 0.7]), ratio=rnd.choice([0.1, 0.6, 1.2]), avg_last_2=rnd.choice([-1.0, 0.0, 0.25, None]), adx28=rnd.randrange(40),
                   adx14=rnd.randrange(40), adx7=rnd.randrange(40), rsi_extreme=rnd.random() < 0.5, prev_lasted=rnd.choice([True, False, None]), entry_sec=rnd.choice([23400, 25000, 32399, 33000])) for i in lad}
    entries = spark.createDataFrame([(i, *e.values()) for i, e in ent.items()], "trade_id bigint, vol double, ratio double, avg_last_2 double, adx28 int, adx14 int, adx7 int, rsi_extreme boolean, prev_lasted boolean, entry_sec int")
    sets = sweeps.valid_exit_sets(2)[::40]
    hits = sweeps.hit_table(paths.price_ladder(paths.trade_path(t, k)), sweeps.TARGET_1, -5, 11, min_rungs=4)
    for mode in (1, 3):
        dims = sweeps.search_dims(mode, adx14=(0, 20), adx7=(0,))
        cells = sweeps.grid_search_cells(entries, hits, sets, sweeps.TARGET_1, -5, 11, dims).collect()
        expect = {}
        flag = lambda want, v: want == "either" or (v is not None and (want == "true") == v)
        for i, e in ent.items():
            if len(lad[i]) <= 3 or e["avg_last_2"] is None:
                continue
            vols = [v for v in sweeps.VOLATILITIES if e["vol"] >= v and (mode == 3 or e["vol"] < (0.6 if v == 0 else 3.0))]
            times = [None] if mode == 1 else [a for a, b in zip(sweeps.ENTRY_TIMES, sweeps.ENTRY_TIMES[1:]) if a <= e["entry_sec"] < b]
            opts = [times, vols, [x for x in sweeps.RATIOS if e["ratio"] >= x], [x for x in sweeps.AVG_LAST_2 if e["avg_last_2"] >= x], [x for x in sweeps.ADX if e["adx28"] >= x],
                    [x for x in (0, 20) if e["adx14"] >= x], [x for x in ("true", "false", "either") if flag(x, e["rsi_extreme"])], [x for x in ("true", "false", "either") if flag(x, e["prev_lasted"])]]
            for combo in product(*opts):
                for j, s in enumerate(sets):
                    v, w = race(lad[i], *s)
                    c = expect.setdefault((*combo, j), [0, 0, 0, 0])
                    c[0] += v
                    c[1 if w == 1 else 2 if w == -1 else 3] += 1
        got = {(r.entry_time if mode == 3 else None, r.vol, r.ratio, r.avg_last_2, r.adx28, r.adx14, r.rsi, r.min4, r.exit_id): [r.tenths, r.wins, r.losses, r.neither] for r in cells}
        assert got == expect and len(got) > 100


def test_stop_state_loop(spark):
    ticks, rows, k, t = frames(spark, seed=5)
    got = {}
    for r in paths.stop_state_path(paths.roi_path(t, k, FULL_DAY)).collect():
        got.setdefault(r.trade_id, []).append((r.sec, r.roi))
    finals = {(r.trade_id, r.hold): r.final_roi for r in stats.holding_outcomes(paths.roi_path(t, k, FULL_DAY), (0.4, 0.6, 1.0)).collect()}
    for row in rows:
        series = [float(np.round(x, 2)) + 0.0 for x in rois(ticks, row)]
        for hold in (0.4, 0.6, 1.0):
            out, armed = [], False
            for x in series:
                out.append(x)
                if x <= -0.4 or (armed and x <= 0.0):
                    break
                armed = armed or x >= hold
            if hold == 0.6:
                assert [v for _, v in sorted(got[row[0]])] == out
            assert finals[(row[0], hold)] == out[-1]


def test_day_curve_loop(spark):
    ticks, rows, k, t = frames(spark, seed=7)
    p = paths.roi_path(t, k, FULL_DAY)
    curve = {r.sec: r.day_roi for r in trades.day_pnl_curve(p).collect()}
    latest, by_sec = {}, {}
    for r in p.orderBy("sec").collect():
        by_sec.setdefault(r.sec, []).append((r.trade_id, r.roi))
    for s in sorted(by_sec):
        latest.update(dict(by_sec[s]))
        assert abs(curve[s] - sum(latest.values())) < 1e-3


ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 90_000), st.integers(-5, 5), st.booleans()), min_size=1, max_size=40)


@FEW
@given(rows=ROWS)
def test_blocked_running_values_equal_plain_windows(spark, rows):
    # group 0 holds most rows, as a hot key would
    data = [(0 if g < 3 else 1, s, i, v if keep else None, v) for i, (g, s, v, keep) in enumerate(rows)]
    df = spark.createDataFrame(data, "g int, sec int, id bigint, x int, v int")
    w = Window.partitionBy("g").orderBy("sec", "id")
    plain = {r.id: (r.s, r.back, r.fwd, r.lag) for r in df.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("back"),
        F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("fwd"),
        F.lag("sec").over(w).alias("lag")).collect()}
    b = blocks.time_block()
    s = {r.id: r.s for r in blocks.running_sum(df, ["g"], b, ["sec", "id"], {"s": F.col("v")}).collect()}
    back = {r.id: r.o for r in blocks.carry_value(df, ["g"], b, ["sec", "id"], F.col("x"), "o").collect()}
    fwd = {r.id: r.o for r in blocks.carry_value(df, ["g"], b, ["sec", "id"], F.col("x"), "o", forward=True).collect()}
    lag = {r.id: r.o for r in blocks.carry_value(df, ["g"], b, ["sec", "id"], F.col("sec"), "o", inclusive=False).collect()}
    assert {i: (s[i], back[i], fwd[i], lag[i]) for i in plain} == plain


@FEW
@given(qty=st.lists(st.integers(-3, 3).filter(bool), min_size=1, max_size=25))
def test_episodes_conserve_quantity(spark, qty):
    df = spark.createDataFrame([("A", DAY, 1000 * i, i, 100.0 + i, q) for i, q in enumerate(qty)], "ticker string, trade_date date, sec int, fill_id bigint, net_price double, qty int")
    pos, ep, expect = 0, 0, {}
    for i, q in enumerate(qty):
        ep += pos == 0
        pos += q
        expect.setdefault(ep, []).append(i)
    got = {}
    for r in trades.position_episodes(df).collect():
        got.setdefault(r.ep, []).append(r.fill_id)
    assert {k: sorted(v) for k, v in got.items()} == expect
    closed = trades.round_trips(trades.position_episodes(df)).count()
    assert closed == len(expect) - (pos != 0)


@FEW
@given(seed=st.integers(0, 10_000))
def test_path_properties(spark, seed):
    _, rows, k, t = frames(spark, seed)
    path = paths.roi_path(t, k, FULL_DAY)
    whole = {}
    for r in paths.best_future_roi(path).collect():
        whole.setdefault(r.trade_id, []).append((r.sec, r.roi, r.best_future))
    for v in whole.values():
        v.sort()
        best = [b for _, _, b in v]
        assert best == sorted(best, reverse=True)  # never rises along a path
    kept = {}
    for r in paths.stop_state_path(path).collect():
        kept.setdefault(r.trade_id, []).append((r.sec, r.roi))
    for i, v in kept.items():
        assert sorted(v) == [(s, x) for s, x, _ in whole[i][: len(v)]]  # a prefix
    for r in sweeps.simulate_exit(path).collect():
        last = round(whole[r.trade_id][-1][1], 2)
        assert r.result in (r.target, r.stop) or abs(r.result - last) < 0.0051


def test_curve_total_equals_finals(spark):
    _, _, k, t = frames(spark, 11)
    path = paths.roi_path(t, k, FULL_DAY)
    curve = trades.day_pnl_curve(path)
    total = sweeps.exit_threshold_sweep(curve, (1e9,)).first().total_profit
    finals = sum(r.final_roi for r in trades.day_pnl_extremes(path).collect())
    assert abs(total - finals / 6) < 1e-3


def test_recent_context_over_days(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("AB"), DAY + dt.timedelta(days=rnd.randrange(6)), rnd.randrange(80_000), rnd.randrange(500), float(rnd.randrange(-9, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "trade_id bigint, ticker string, trade_date date, entry_sec int, duration_sec int, pct_change double")
    got = {r.trade_id: (r.avg_last_2, r.prev_lasted) for r in trades.recent_trade_context(df).collect()}
    for tick in "AB":
        seq = sorted((r for r in rows if r[1] == tick), key=lambda r: (r[2], r[3], r[0]))
        for j, r in enumerate(seq):
            prev = seq[max(0, j - 2):j]
            want = (round(sum(p[5] for p in prev) / len(prev), 6) if prev else None, prev[-1][4] >= 240 if prev else None)
            assert got[r[0]] == want
