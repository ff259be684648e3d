"""First positions of rungs, before and after anchors: one read of the path, against plain loops."""

import random

from tickloom.operators import paths, sweeps

LOW, HIGH, ANCHORS = -5, 11, (2, 3, 4, 5)


def brute(ladder):
    per = {}
    for trade, pos, rung in sorted(ladder):
        per.setdefault(trade, []).append((pos, rung))
    out = {}
    for trade, steps in per.items():
        first = {}
        for pos, rung in steps:
            first.setdefault(rung, pos)
        hits = [first.get(r) for r in range(LOW, HIGH + 1)]
        for a in ANCHORS:
            hits += [min((p for p, x in steps if x == r and a in first and p > first[a]), default=None) for r in range(LOW, HIGH + 1)]
        out[trade] = (steps[-1][1], len(steps), hits)
    return {t: x for t, x in out.items() if x[1] >= 4}


def test_hits_read_the_path_once_and_sort_ticks_only(spark, tmp_path):
    rng = random.Random(4)
    rows = [(t, s, 100 * t + s, rng.uniform(-0.9, 1.5) if t % 3 else rng.uniform(-0.1, 0.3)) for t in range(60) for s in range(rng.randint(1, 12))]
    spark.createDataFrame(rows, "trade_id long, sec int, tick_id long, raw_roi double").repartition(3).write.parquet(f"{tmp_path}/path")
    path = spark.read.parquet(f"{tmp_path}/path")
    want = brute([tuple(r) for r in paths.price_ladder(path).select("trade_id", "pos", "rung").collect()])
    for ladder in (paths.price_ladder(path), paths.price_ladder(path, ANCHORS)):
        got = sweeps.hit_table(ladder, ANCHORS, LOW, HIGH, 4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r.trade_id: (r["last"], r.rungs, r.hits) for r in got.collect()} == want
    assert plan.count("FileScan") == 1 and plan.count("Sort [") == 1
