"""The registered grid searches over their default lists, against plain loops on a small fixture."""

import random
from itertools import product

import pytest

import __spark_entry__ as entry
from test_brute import frames, ladder, race, rois
from tickloom.operators import paths, sweeps
from tickloom.plans import q_sweeps

NAMES = ("vol", "ratio", "avg_last_2", "adx28", "adx14", "adx7", "rsi", "min4")


@pytest.fixture
def small(spark, monkeypatch):
    ticks, rows, k, t = frames(spark)
    lad = {r[0]: ladder(rois(ticks, r)) for r in rows}
    rnd = random.Random(11)
    ent = {}
    for i in sorted(lad):
        x = [rnd.choice([5, 25, 35]) for _ in range(3)]
        ent[i] = dict(vol=rnd.choice([0.1, 0.35, 0.55, 0.7]), ratio=rnd.choice([0.1, 0.6]), avg_last_2=rnd.choice([-1.0, 0.0, 0.25]), adx28=x[0], adx14=x[1], adx7=x[2],
                      rsi_extreme=rnd.random() < 0.5, prev_lasted=rnd.choice([True, False, None]), entry_sec=rnd.choice([100, 6000, 40000]))
    entries = spark.createDataFrame([(i, *e.values()) for i, e in ent.items()], "trade_id bigint, vol double, ratio double, avg_last_2 double, adx28 int, adx14 int, adx7 int, rsi_extreme boolean, prev_lasted boolean, entry_sec int")
    sets = sweeps.valid_exit_sets(2)[::60]
    hits = sweeps.hit_table(paths.price_ladder(paths.trade_path(t, k)), sweeps.TARGET_1, -5, 11, min_rungs=4)
    monkeypatch.setattr(q_sweeps, "sweep_entries", lambda spark, sf: entries)
    monkeypatch.setattr(q_sweeps, "_hits", lambda spark, sf: hits)
    monkeypatch.setattr(sweeps, "valid_exit_sets", lambda stages: sets)
    return lad, ent, sets


def loops(lad, ent, sets, mode, k=10):
    """(group, values...) of the best rows by plain loops."""
    flag = lambda want, v: want == "either" or (v is not None and (want == "true") == v)
    cells = {}
    for i, e in ent.items():
        if len(lad[i]) <= 3:
            continue
        vols = [v for v in sweeps.VOLATILITIES if e["vol"] >= v and (mode != 1 or e["vol"] < (0.6 if v == 0 else 3.0))]
        times = [None] if mode != 3 else [a for a in range(0, 81000, 5400) if a <= e["entry_sec"] < a + 5400]
        floors = [[x for x in sweeps.ADX if e[n] >= x] for n in ("adx28", "adx14", "adx7")]
        flags = [[x for x in ("either", "false", "true") if flag(x, e[n])] for n in ("rsi_extreme", "prev_lasted")]
        results = [race(lad[i], *s) for s in sets]
        for combo in product(times, vols, [x for x in sweeps.RATIOS if e["ratio"] >= x], [x for x in sweeps.AVG_LAST_2 if e["avg_last_2"] >= x], *floors, *flags):
            for j, (v, w) in enumerate(results):
                c = cells.setdefault((*combo, j), [0, 0, 0, 0])
                c[0] += v
                c[1 if w == 1 else 2 if w == -1 else 3] += 1
    out, seen = [], {}
    for key, c in sorted((x for x in cells.items() if x[1][0] >= 20), key=lambda x: (-x[1][0], *(0 if y is None else y for y in x[0]))):
        group = None if mode == 1 else key[1] if mode == 2 else key[0]
        seen[group] = seen.get(group, 0) + 1
        if seen[group] <= k:
            out.append((*key[:-1], *(x / 10 for x in sets[key[-1]]), c[0] / 10, *c[1:], None if mode == 1 else seen[group]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_registered_mode(spark, small, mode):
    want = loops(*small, mode)
    got = entry.queries()[f"J6_grid_search_mode{mode}"](spark, "").collect()
    rows = [(r.entry_time if mode == 3 else None, *(r[n] for n in NAMES), r.t1, r.sl1, r.t2, r.sl2, r["sum"], r.wins, r.losses, r.neither, None if mode == 1 else r["rank"]) for r in got]
    assert sorted(rows, key=repr) == want and len(want) >= 10
    assert any(r[4:7] != (0, 0, 0) for r in want)


def test_report(spark, small):
    want = loops(*small, 2)
    got = entry.queries()["J15_sweep_report"](spark, "").collect()
    assert sorted((r.section, r["sum"], r.wins, r.losses, r.neither, r["rank"]) for r in got) == sorted((r[1], *r[-5:]) for r in want)
