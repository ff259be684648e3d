"""J3 and J4 by loops: cubes of nested, banded and flagged dimensions, and exit rules found once per prefix."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import sweeps
from tickloom.operators.cube import Best, Dim, dense_sums, filter_grid

FLOORS, BANDS = (0.0, 0.3, 0.5, 0.5), ((0, 10), (5, 20), (20, 30))


def dims():
    return [
        Dim.bands("band", F.col("sec"), BANDS, ("x", "y", "z")), Dim.floors("vol", F.col("vol"), FLOORS[:3]), Dim.floors("low_first", F.col("vol"), (0.5, 0.0)),
        Dim.floors("adx", F.col("adx"), (0, 20)), Dim.flag("rsi", F.col("rsi")),
    ]


def passed(r):
    _, vol, adx, sec, rsi, _, _ = r
    return [
        [n for n, (a, b) in zip("xyz", BANDS) if sec is not None and a <= sec < b], [x for x in FLOORS[:3] if vol is not None and vol >= x],
        [x for x in (0.5, 0.0) if vol is not None and vol >= x], [x for x in (0, 20) if adx is not None and adx >= x],
        ["either"] + ([] if rsi is None else ["true" if rsi else "false"]),
    ]


def some_rows(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice("pq"), rnd.choice([None, -0.1, 0.0, 0.4, 0.7]), rnd.choice([None, 5, 25]), rnd.choice([None, 3, 7, 15, 29, 40]), rnd.choice([True, False, None]), rnd.randint(-9, 9), rnd.choice([0.5, 0.25, 2.0])) for _ in range(n)]


SCHEMA = "who string, vol double, adx int, sec int, rsi boolean, tenths long, weight double"
NAMES = ("band", "vol", "low_first", "adx", "rsi")


def by_loops(rows, by):
    cells = {}
    for r in rows:
        for combo in product(*passed(r)):
            c = cells.setdefault((r[0],) + combo if by else combo, [0, 0, 0.0])
            c[0] += 1
            c[1] += r[5]
            c[2] += r[6]
    return {(*k, *v) for k, v in cells.items()}


@pytest.mark.parametrize("by,most", [([], 1 << 18), (["who"], 1 << 18), (["who"], 10), ([], 1)])
def test_filter_grid(spark, by, most):
    rows = some_rows(len(by) + most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = filter_grid(df, dims(), by, {"n": F.lit(1).cast("long"), "tenths": F.col("tenths"), "weight": F.col("weight")}, most_cells=most)
    assert got.columns == [*by, *NAMES, "n", "tenths", "weight"]
    assert {tuple(r) for r in got.collect()} == by_loops(rows, bool(by))
    assert filter_grid(df.limit(0), dims(), by, {"n": F.lit(1).cast("long")}).collect() == []


@pytest.mark.parametrize("per", [None, "vol", "band"])
@pytest.mark.parametrize("most", [1 << 18, 30])
def test_best_keeps_all_that_can_win(spark, per, most):
    rows = some_rows(9)
    got = filter_grid(spark.createDataFrame(rows, SCHEMA), dims(), ["who"], {"tenths": F.col("tenths")}, Best("tenths", 4, 1, per), most)
    got = {tuple(r) for r in got.collect()}
    cells = {(*c[:6], c[7]) for c in by_loops(rows, True)}
    want = set()
    for who in "pq":
        for label in {c[1 + NAMES.index(per)] for c in cells} if per else [None]:
            some = sorted((c for c in cells if c[0] == who and c[-1] >= 1 and (per is None or c[1 + NAMES.index(per)] == label)), key=lambda c: -c[-1])
            want |= {c for c in some if len(some) <= 4 or c[-1] >= some[3][-1]}
    assert want <= got <= cells


def test_dense_sums_of_a_hundred_thousand_equal_rows():
    m = np.full(100_000, 3)
    cube = dense_sums([m], [Dim("a", (0, 1, 2), None, True)], np.ones(100_000, np.int64))
    assert cube.tolist() == [100_000, 100_000, 0]


def outcome(hits, last, rule):
    """(tenths, result) by walking the stages; hits[anchor][rung] is a position."""
    pairs = list(zip(rule[::2], rule[1::2]))
    anchor = None
    for depth, (t, s) in enumerate(pairs):
        p_t, p_s = hits[anchor].get(t, 1e9), hits[anchor].get(s, 1e9)
        if p_t == p_s:
            return last, "neither"
        if p_s < p_t:
            return s, "win" if depth == 2 else "loss"
        if depth == len(pairs) - 1:
            return t, "win"
        anchor = pairs[0][0]


@pytest.mark.parametrize("stages", [2, 3])
def test_exit_rules_by_prefix(spark, stages):
    rnd = random.Random(stages)
    sets, anchors, low, high = sweeps.valid_exit_sets(stages), sweeps.TARGET_1, -5, 11
    width, rows, plain = high - low + 1, [], {}
    for trade in range(25):
        hits = {a: {r: rnd.randint(1, 60) for r in range(low, high + 1) if rnd.random() < 0.7} for a in (None, *anchors)}
        flat = [hits[a].get(r) for a in (None, *anchors) for r in range(low, high + 1)]
        rows.append((trade, rnd.randint(-9, 9), flat, trade % 3))
        plain[trade] = hits
    df = spark.createDataFrame(rows, "trade_id long, last int, hits array<int>, mark int")
    assert len(rows[0][2]) == width * 5
    nodes = sweeps.ladder_outcomes(df, sets, anchors, low, high)
    assert nodes.count() < 25 * len(sets) / 2
    got = {(r["trade_id"], r["exit_id"]): (r["tenths"], "win" if r["win"] else "loss" if r["loss"] else "neither", r["win"] + r["loss"] + r["neither"], r["mark"]) for r in sweeps.ladder_exits(df, sets, anchors, low, high, ["mark"]).collect()}
    want = {(i, j): (*outcome(plain[i], last, s), 1, mark) for i, last, _, mark in rows for j, s in enumerate(sets)}
    assert got == want
