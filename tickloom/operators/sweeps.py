"""Scenario sweeps: many entry filters and exit rules over one trade history.

Exit rules are evaluated once per (trade, rule) from first-hit positions; entry filters are never
joined to trades. Instead trades collapse to the set of levels they satisfy, and the filter cells are
built from those few sets (``filter_grid``). Rungs, targets and stops are integer tenths of a percent,
so sums are exact.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.clock import minutes_since_open
from tickloom.functions.numbers import round_to
from tickloom.operators import paths
from tickloom.operators.cube import Best, Dim, filter_grid
from tickloom.operators.ends import Chains, Hit
from tickloom.session import MARKET_HOURS, SessionSpec

# fixed values: default sweep lists (levels as given, exit levels in tenths of a percent)
VOLATILITIES = (0.0, 0.3, 0.4, 0.5, 0.6)
RATIOS = (0.0, 0.2, 0.5, 0.7, 0.8, 0.9, 1.0)
AVG_LAST_2 = (-5.0, -0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4)
ADX = (0, 20, 30)
ENTRY_TIMES = tuple(23400 + 600 * i for i in range(16))  # 06:30 .. 09:00 every 10 minutes
TARGET_1 = (2, 3, 4, 5)
TARGET_2 = (3, 4, 5, 6, 7, 8, 9)
TARGET_3 = (6, 7, 8, 9, 10, 11)
STOP_1 = (-5, -4, -3)
STOP_2 = (-3, -2, -1, 0, 1, 2, 3)
STOP_3 = (2, 3, 4, 5, 6)
TICK_TARGETS = (0.2, 0.3, 0.4, 0.5)
TICK_STOPS = (-0.5, -0.4, -0.3)
MIN_SUM_TENTHS = 20  # keep sum >= 2.0
VOL_MODE1_LOW_TOP, VOL_MODE1_TOP = 0.6, 3.0


# ---------------------------------------------------------------- exit rules

def valid_exit_sets(stages: int = 2) -> list[tuple[int, ...]]:
    """(t1, sl1, t2, sl2) or (t1, sl1, t2, sl2, t3, sl3) in tenths, compared as integers."""
    if stages == 2:
        return [
            (t1, s1, t2, s2) for t1, s1, t2, s2 in product(TARGET_1, STOP_1, TARGET_2, STOP_2)
            if s1 < t1 - 1 and t1 < t2 and s1 < s2 < t1 - 1
        ]
    return [
        (t1, s1, t2, s2, t3, s3)
        for t1, s1, t2, s2, t3, s3 in product(TARGET_1, STOP_1, TARGET_2, STOP_2, TARGET_3, STOP_3)
        if s1 < t1 - 1 and t1 < t2 < t3 and s1 < s2 < t2 - 1 and s2 < s3 < t3 - 1
    ]


def valid_two_target_sets() -> list[tuple[int, ...]]:
    """Exit sets of the volatility / ratio / parameter sweep."""
    targets, uppers = range(2, 7), range(3, 10)
    upper_stops, stops = range(7, -10, -1), range(-3, -10, -1)
    return [
        (t, s, u, us) for t, u, us, s in product(targets, uppers, upper_stops, stops)
        if u > t and us < u and us < t and s < t and s < us
    ]


NAMES = ("t1", "sl1", "t2", "sl2", "t3", "sl3")


def _literal_sets(sets: Sequence[tuple[int, ...]]) -> Column:
    """The sets as one constant array of structs (a JSON literal, folded once by the optimizer)."""
    names = NAMES[: len(sets[0])]
    text = json.dumps([{"exit_id": i, **dict(zip(names, s))} for i, s in enumerate(sets)])
    fields = ", ".join(f"{n}: int" for n in ("exit_id", *names))
    return F.from_json(F.lit(text), f"array<struct<{fields}>>")


def hit_table(ladder: DataFrame, anchors: Sequence[int], low: int, high: int, min_rungs: int = 1) -> DataFrame:
    """One row per trade: first positions of rungs low..high, from the start and after each anchor.

    ``hits`` holds len(anchors) + 1 blocks of (high - low + 1) positions, null where not hit. ``last``
    is the last rung. Ladders shorter than ``min_rungs`` are left out: only the grid search asks for that (4).
    The ladder is read once, and one aggregate fills all slots; anchors that the ladder has no positions of (see ``price_ladder``) take a sort of it.
    """
    before = Window.partitionBy("trade_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    rows = ladder.withColumns({f"at_{a}": F.min(F.when(F.col("rung") == a, F.col("pos"))).over(before) for a in anchors if f"at_{a}" not in ladder.columns})
    blocks = [F.lit(True), *[F.col(f"at_{a}").isNotNull() for a in anchors]]
    slots = [F.min(F.when(seen & (F.col("rung") == rung), F.col("pos"))) for seen in blocks for rung in range(low, high + 1)]
    per_trade = rows.groupBy("trade_id").agg(F.max("pos").alias("rungs"), F.max_by("rung", "pos").alias("last"), *[x.alias(f"_h{i}") for i, x in enumerate(slots)])
    return per_trade.where(F.col("rungs") >= min_rungs).select("trade_id", "last", "rungs", F.array(*[f"_h{i}" for i in range(len(slots))]).alias("hits"))


FAR = 1 << 30


def _first(hits: Column, rung: Column, low: int) -> Column:
    return F.coalesce(F.get(hits, rung - low), F.lit(FAR))


def rule_trie(sets: Sequence[tuple[int, ...]]) -> tuple[list[list[list[dict]]], list[list[int]]]:
    """The exit sets as a prefix tree of (target, stop) pairs.

    ``children[depth][parent]`` lists the nodes {node, t, s} below a node (at depth 0 the only parent is 0), ``leaves[node]`` the exit sets below a
    node. Nodes are numbered over all depths.
    """
    children: list[list[list[dict]]] = []
    leaves: list[list[int]] = []
    parents = {(): 0}
    for depth in range(len(sets[0]) // 2):
        level: list[list[dict]] = [[] for _ in range(max(parents.values()) + 1)]
        found: dict[tuple[int, ...], int] = {}
        for exit_id, x in enumerate(sets):
            prefix = tuple(x[:2 * depth + 2])
            if prefix not in found:
                found[prefix] = len(leaves)
                leaves.append([])
                level[parents[prefix[:-2]]].append({"node": found[prefix], "t": prefix[-2], "s": prefix[-1]})
            leaves[found[prefix]].append(exit_id)
        children.append(level)
        parents = found
    return children, leaves


def _literal(value, kind: str) -> Column:
    """A constant nested value (a JSON literal, folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def ladder_outcomes(hits: DataFrame, sets: Sequence[tuple[int, ...]], anchors: Sequence[int], low: int, high: int, keep: Sequence[str] = ()) -> DataFrame:
    """Outcomes of all exit sets for every trade, found once per shared prefix: (trade_id, keep, node, tenths, win, loss, neither).

    Stage 1 races sl1 against t1; after t1, sl2 races t2 and then sl3 races t3, all with positions
    strictly after the first t1. A trade goes down the tree only below nodes whose target came first, so it has a row for every
    node where its outcome is decided, which stands for all exit sets below it. Reaching the last target or sl3 is a win.
    """
    children, _ = rule_trie(sets)
    width = high - low + 1
    depths = len(children)
    h = F.col("hits")
    node = "array<array<struct<node: int, t: int, s: int>>>"
    rows = hits.select("trade_id", "last", "hits", *keep, F.explode(_literal(children[0], node)[0]).alias("x"))
    rows = rows.select(*rows.columns[:-1], "x.node", F.col("x.t").alias("t"), F.col("x.s").alias("s"), F.col("x.t").alias("_t1"))
    for depth in range(depths):
        block = F.lit(0) if depth == 0 else F.array_position(F.array(*[F.lit(a) for a in anchors]), F.col("_t1")).cast("int") * width
        p_t, p_s = (F.coalesce(F.get(h, block + F.col(c) - low), F.lit(FAR)) for c in ("t", "s"))
        # outcome codes: 0 neither, 1 stop, 2 target
        code = F.when(p_s < p_t, 1).when(p_t < p_s, 2).otherwise(0)
        if depth == 0:
            rows = rows.withColumn("_code", code).withColumn("_depth", F.lit(1))
        else:
            rows = rows.withColumn("_code", F.when(F.col("_depth") == depth + 1, code).otherwise(F.col("_code")))
        if depth + 1 < depths:
            # parents are nodes of this depth, numbered from the first one's number on
            base = min(n["node"] for level in children[depth] for n in level)
            below = F.element_at(_literal(children[depth + 1][base:], node), F.col("node") - base + 1)
            goes_on = (F.col("_depth") == depth + 1) & (F.col("_code") == 2)
            stays = F.array(F.struct(F.col("node").alias("node"), F.col("t").alias("t"), F.col("s").alias("s")))
            rows = rows.withColumn("_next", goes_on).withColumn("x", F.explode(F.when(goes_on, below).otherwise(stays)))
            rows = rows.withColumn("_depth", F.when(F.col("_next"), depth + 2).otherwise(F.col("_depth")))
            rows = rows.drop("node", "t", "s", "_next").withColumns({"node": F.col("x.node"), "t": F.col("x.t"), "s": F.col("x.s")}).drop("x")
    c, last_stage = F.col("_code"), F.col("_depth") == depths
    win = (c == 2) | ((c == 1) & last_stage) if depths == 3 else c == 2
    value = F.when(c == 1, F.col("s")).when(c == 2, F.col("t")).otherwise(F.col("last"))
    one = lambda x: x.cast("long")
    return rows.select("trade_id", *keep, "node", one(value).alias("tenths"), one(win).alias("win"), one((c == 1) & ~win).alias("loss"), one(c == 0).alias("neither"))


def with_exit_sets(outcomes: DataFrame, sets: Sequence[tuple[int, ...]]) -> DataFrame:
    """A row per exit set below the node of each row, as exit_id."""
    leaves = _literal(rule_trie(sets)[1], "array<array<int>>")
    return outcomes.withColumn("exit_id", F.explode(F.element_at(leaves, F.col("node") + 1))).drop("node")


def ladder_exits(hits: DataFrame, sets: Sequence[tuple[int, ...]], anchors: Sequence[int], low: int, high: int, keep: Sequence[str] = ()) -> DataFrame:
    """Outcome of every exit set for every trade, in tenths of a percent (see ``ladder_outcomes``)."""
    rows = with_exit_sets(ladder_outcomes(hits, sets, anchors, low, high, keep), sets)
    x = F.element_at(_literal_sets(sets), F.col("exit_id") + 1)
    return rows.select("trade_id", *keep, "exit_id", *[x[n].alias(n) for n in NAMES[: len(sets[0])]], "tenths", "win", "loss", "neither")


def simulate_exit(path: DataFrame, targets: Sequence[float] = TICK_TARGETS, stops: Sequence[float] = TICK_STOPS) -> DataFrame:
    """Per trade and (target, stop): the level reached first, stop before target on the same tick,
    else the return of the last tick. One aggregate finds the first crossing of every level."""
    at = F.struct("sec", "tick_id")
    r = F.col("raw_roi")
    g = path.groupBy("trade_id").agg(
        *[F.min(F.when(r >= t, at)).alias(f"_t{i}") for i, t in enumerate(targets)],
        *[F.min(F.when(r <= s, at)).alias(f"_s{i}") for i, s in enumerate(stops)],
        F.max_by(r, at).alias("_last"),
    )
    combos = []
    for i, t in enumerate(targets):
        for j, s in enumerate(stops):
            hit_t, hit_s = F.col(f"_t{i}"), F.col(f"_s{j}")
            stop_first = hit_s.isNotNull() & (hit_t.isNull() | (hit_s <= hit_t))
            result = F.when(stop_first, F.lit(s)).when(hit_t.isNotNull(), F.lit(t)).otherwise(round_to("_last", 4))
            combos.append(F.struct(F.lit(i * len(stops) + j).alias("exit_id"), F.lit(t).alias("target"), F.lit(s).alias("stop"), result.alias("result")))
    return g.select("trade_id", F.explode(F.array(*combos)).alias("x")).select("trade_id", "x.*")


# ---------------------------------------------------------------- entry filters

def vol_mode1(value: Column, levels: Sequence[float] = VOLATILITIES) -> Dim:
    """Mode 1 volatility: level 0 means [0, 0.6), any other level means [level, 3.0)."""
    bands = [(v, VOL_MODE1_LOW_TOP if v == 0.0 else VOL_MODE1_TOP) for v in levels]
    return Dim.bands("vol", value, bands, levels)


def search_dims(mode: int, adx28=ADX, adx14=ADX, adx7=ADX, times: Sequence[int] = ENTRY_TIMES) -> list[Dim]:
    """Filter dimensions of the grid search over columns vol, ratio, avg_last_2, adx28/14/7,
    rsi_extreme, prev_lasted and entry_sec."""
    vol = vol_mode1(F.col("vol")) if mode == 1 else Dim.floors("vol", F.col("vol"), VOLATILITIES)
    dims = [vol, Dim.floors("ratio", F.col("ratio"), RATIOS), Dim.floors("avg_last_2", F.col("avg_last_2"), AVG_LAST_2)]
    if mode == 3:
        bands = list(zip(times[:-1], times[1:]))
        dims.insert(0, Dim.bands("entry_time", F.col("entry_sec"), bands, times[:-1]))
    dims += [Dim.floors(n, F.col(n), lv) for n, lv in (("adx28", adx28), ("adx14", adx14), ("adx7", adx7))]
    return dims + [Dim.flag("rsi", F.col("rsi_extreme")), Dim.flag("min4", F.col("prev_lasted"))]


def grid_search_cells(entries: DataFrame, hits: DataFrame, sets, anchors, low: int, high: int, dims: Sequence[Dim], without_ladder: bool = False, best: Best | None = None) -> DataFrame:
    """J6 before ranking: sum, count, wins, losses, neither per filter combination and exit set.

    Trades without a row in ``hits`` are left out, or count as neither, with 0. Trades of equal masks add up per node of the exit sets' tree before
    nodes are spread to the exit sets below them. With ``best`` only cells that can be among the best ones come back.
    """
    masks = [d.name for d in dims]
    packed = entries.select("trade_id", *[d.mask.alias(d.name) for d in dims])
    hits = hits.hint("merge")  # its size is judged by the path it comes from; the same plan at every size
    joined = packed.join(hits, "trade_id", "left").na.fill(0, ["last"]) if without_ladder else hits.join(packed, "trade_id")
    sums = {"tenths": "tenths", "wins": "win", "losses": "loss", "neither": "neither"}
    nodes = ladder_outcomes(joined, sets, anchors, low, high, keep=masks).groupBy(*masks, "node").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cells = filter_grid(with_exit_sets(nodes, sets), [d.of(F.col(d.name)) for d in dims], ["exit_id"], {n: F.col(n) for n in sums}, best)
    return cells.withColumn("n", F.col("wins") + F.col("losses") + F.col("neither"))


def best_of_mode(mode: int, k: int = 10, min_tenths: int = MIN_SUM_TENTHS) -> Best:
    """What ``grid_search`` asks of the cells."""
    return Best("tenths", k, min_tenths, {1: None, 2: "vol", 3: "entry_time"}[mode])


def grid_search(cells: DataFrame, dims: Sequence[Dim], sets, mode: int, k: int = 10, min_tenths: int = MIN_SUM_TENTHS) -> DataFrame:
    """Best k overall (mode 1), per volatility level (2) or per entry-time band (3)."""
    names = [d.name for d in dims]
    good = cells.where(F.col("tenths") >= min_tenths)
    if mode == 1:
        best = good.orderBy(F.desc("tenths"), *names, "exit_id").limit(k)
    else:
        w = Window.partitionBy("vol" if mode == 2 else "entry_time").orderBy(F.desc("tenths"), *names, "exit_id")
        best = good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    params = F.element_at(_literal_sets(sets), F.col("exit_id") + 1)
    extra = [c for c in ("rank",) if c in best.columns]
    return best.select(
        *names, "exit_id", *[(params[n] / 10.0).alias(n) for n in NAMES[: len(sets[0])]],
        (F.col("tenths") / 10.0).alias("sum"), "n", "wins", "losses", "neither",
        round_to(F.col("tenths") / 10.0 / F.col("n"), 2).alias("avg"), *extra,
    )


def grid_search_ticks(entries: DataFrame, exits: DataFrame, k: int = 10) -> DataFrame:
    """Vol, ratio, adx28/14/7 floors x (target, stop) on tick-level exits; best k by total return."""
    dims = [Dim.floors("vol", F.col("vol"), VOLATILITIES), Dim.floors("ratio", F.col("ratio"), RATIOS)]
    dims += [Dim.floors(n, F.col(n), ADX) for n in ("adx28", "adx14", "adx7")]
    packed = entries.select("trade_id", *[d.mask.alias(d.name) for d in dims])
    rows = exits.join(packed, "trade_id")
    ready = [d.of(F.col(d.name)) for d in dims]
    # returns in whole 1e-4 percent: exact sums in any order
    cells = filter_grid(rows, ready, ["exit_id", "target", "stop"], {"units": F.rint(F.col("result") * 10000).cast("long"), "n": F.lit(1).cast("long")}, Best("units", k, -(1 << 62)))
    names = [d.name for d in dims]
    return cells.withColumn("total", F.col("units") / 10000.0).orderBy(F.desc("units"), *names, "exit_id").limit(k).select(
        *names, "target", "stop", "total", "n"
    )


# ---------------------------------------------------------------- volatility x ratio

# fixed values: floors of the volatility / ratio sweeps
SWEEP_VOLS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2)
SWEEP_RATIOS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)
PARAM_VOLS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
PARAM_RATIOS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)
PARAM_BIAS = (0.0, 0.1, 0.2, 0.3, 0.4)


def with_empty_cells(cells: DataFrame, levels: dict[str, Sequence], sums: Sequence[str]) -> DataFrame:
    """A row for every combination of the constant ``levels``; those without trades have sums of 0."""
    grid = cells.sparkSession.range(1).select()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(cells, list(levels), "left").na.fill(0, list(sums))


def vol_ratio_sweep(entries: DataFrame, hits: DataFrame, low: int) -> DataFrame:
    """Per (vol, ratio) floor the results of two exit rules: first of +-0.3 ('basic'), and
    0.5 / 0.9 with stops -0.5 / -0.1 ('complex'). Every floor pair has a row; a trade without a ladder counts as neither, with 0."""
    h, last = F.col("hits"), F.coalesce("last", F.lit(0))
    up, down = _first(h, F.lit(3), low), _first(h, F.lit(-3), low)
    basic = F.when(up < down, 3).when(down < up, -3).otherwise(last)
    # the only anchor of this sweep is 5, so its block is the second one
    width = 9 - low + 1

    def later(rung: int) -> Column:
        return F.coalesce(F.get(h, F.lit(width + rung - low)), F.lit(FAR))

    t1, s1 = _first(h, F.lit(5), low), _first(h, F.lit(-5), low)
    complex_ = F.when(s1 < t1, -5).when(
        t1 < s1, F.when(later(-1) < later(9), -1).when(later(9) < later(-1), 9).otherwise(last)
    ).otherwise(last)
    rows = entries.join(hits.hint("merge"), "trade_id", "left").select(
        "vol", "ratio",
        F.explode(F.array(
            F.struct(F.lit("basic").alias("rule"), basic.cast("long").alias("tenths")),
            F.struct(F.lit("complex").alias("rule"), complex_.cast("long").alias("tenths")),
        )).alias("o"),
    ).select("vol", "ratio", "o.*")
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
    b, x = F.col("rule") == "basic", F.col("tenths")
    win = one(F.when(b, x == 3).otherwise(x == 9))
    upper_sl = one(~b & (x == -1))
    loss = one(F.when(b, x == -3).otherwise(x == -5))
    dims = [Dim.floors("vol", F.col("vol"), SWEEP_VOLS), Dim.floors("ratio", F.col("ratio"), SWEEP_RATIOS)]
    sums = {"tenths": x, "n": F.lit(1).cast("long"), "wins": win, "upper_sl_losses": upper_sl, "losses": loss}
    cells = with_empty_cells(filter_grid(rows, dims, ["rule"], sums), {"rule": ("basic", "complex"), "vol": SWEEP_VOLS, "ratio": SWEEP_RATIOS}, sums)
    return cells.select(
        "rule", "vol", "ratio", "n", "wins", "upper_sl_losses", "losses",
        (F.col("n") - F.col("wins") - F.col("upper_sl_losses") - F.col("losses")).alias("neither"),
        (F.col("tenths") / 10.0).alias("net"),
    )


def top_5_combos(cells: DataFrame, k: int = 5) -> DataFrame:
    """H3: best k cells of each rule by net change."""
    w = Window.partitionBy("rule").orderBy(F.desc("net"), "vol", "ratio")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vol_ratio_param_sweep(entries: DataFrame, hits: DataFrame, anchors, low: int, high: int, k: int = 10) -> DataFrame:
    """Vol, ratio and directional-bias floors x all valid two-target exit sets; best k by sum.

    Combinations without trades take part with 0, and so do trades without a ladder (as neither).
    """
    sets = valid_two_target_sets()
    dims = [
        Dim.floors("vol", F.col("vol"), PARAM_VOLS), Dim.floors("ratio", F.col("ratio"), PARAM_RATIOS),
        Dim.floors("bias", F.col("bias"), PARAM_BIAS),
    ]
    cells = grid_search_cells(entries, hits, sets, anchors, low, high, dims, without_ladder=True)
    names = [d.name for d in dims]
    levels = {"vol": PARAM_VOLS, "ratio": PARAM_RATIOS, "bias": PARAM_BIAS, "exit_id": range(len(sets))}
    cells = with_empty_cells(cells, levels, ("tenths", "n", "wins", "losses", "neither"))
    best = cells.orderBy(F.desc("tenths"), *names, "exit_id").limit(k)
    params = F.element_at(_literal_sets(sets), F.col("exit_id") + 1)
    return best.select(
        *names, *[(params[n] / 10.0).alias(n) for n in NAMES[:4]], (F.col("tenths") / 10.0).alias("sum"), "n", "wins", "losses", "neither"
    )


# ---------------------------------------------------------------- day exits and races

THRESHOLDS = tuple(1 + 0.25 * i for i in range(9))  # fixed values: 1.0 .. 3.0


def exit_threshold_sweep(curve: DataFrame, thresholds: Sequence[float] = THRESHOLDS, positions: int = 6) -> DataFrame:
    """Leave everything at the first second of a day whose total / positions reaches a threshold,
    else at the end of the day. All thresholds come from one aggregate per day; ``best`` marks the one with the highest total."""
    share = F.col("day_roi") / float(positions)
    per_day = curve.groupBy("trade_date").agg(
        *[F.min_by(share, F.when(share >= t, F.col("sec"))).alias(f"_h{i}") for i, t in enumerate(thresholds)],
        F.max_by(share, "sec").alias("_end"),
    )
    items = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_h{i}").alias("hit"), F.coalesce(f"_h{i}", "_end").alias("profit")) for i, t in enumerate(thresholds)])
    rows = per_day.select(F.explode(items).alias("x")).select("x.*")
    hit, p = F.col("hit").isNotNull(), F.col("profit")
    zero = F.lit(0.0)
    per = rows.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("days"), F.sum(hit.cast("long")).alias("days_hit"),
        round_to(F.sum("profit"), 4).alias("total_profit"),
        round_to(F.sum(hit.cast("double")) / F.count(F.lit(1)) * 100.0, 2).alias("hit_rate"),
        round_to(F.coalesce(F.avg(F.when(p >= F.col("threshold"), p)), zero), 4).alias("avg_hit"),
        round_to(F.coalesce(F.avg(F.when(p < F.col("threshold"), p)), zero), 4).alias("avg_miss"),
    )
    order = Window.orderBy(F.desc("total_profit"), "threshold")  # one row per threshold
    return per.withColumn("best", F.row_number().over(order) == 1)


def race_over(target: float, stop: float) -> Chains:
    """``over`` of ``paths.roi_path`` for J11's race."""
    return [[Hit(target)], [Hit(stop, up=False)]]


def scalp_race(path: DataFrame, target: float, stop: float) -> DataFrame:
    """First tick whose best return so far reaches the target or worst so far the stop; the target
    wins a tie. Trades without such a tick give no row."""
    w = Window.partitionBy("trade_id").orderBy("sec", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    rows = path.withColumn("best", F.greatest(F.max("raw_roi").over(w), zero)).withColumn("worst", F.least(F.min("raw_roi").over(w), zero))
    out = (F.col("best") >= target) | (F.col("worst") <= stop)
    pick = F.struct("sec", "best", "worst")
    g = rows.groupBy("trade_id").agg(F.min_by(pick, F.when(out, F.struct("sec", "tick_id"))).alias("x")).where("x is not null")
    change = F.when(F.col("x.best") >= target, F.col("x.best")).otherwise(F.col("x.worst"))
    return g.select(
        "trade_id", F.col("x.sec").alias("exit_sec"), round_to("x.best", 2).alias("best_pct"), round_to("x.worst", 2).alias("worst_pct"), round_to(change, 2).alias("exit_pct")
    )


STOP_CANDIDATES = (-0.3, -0.4, -0.5, -0.6, -0.7, -0.8)  # fixed values, tightest first


def optimal_stop_loss(path: DataFrame, candidates: Sequence[float], hold: float = 0.6, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """Tightest stop that is not hit before ``hold``; the tightest of all if every stop is hit first.

    Trades whose path reaches neither ``hold`` nor some stop are dropped. ``path`` needs ``vol``.
    """
    order = sorted(candidates, reverse=True)
    at = F.struct("sec", "tick_id")
    g = path.groupBy("trade_id").agg(
        F.min(F.when(F.col("roi") >= hold, at)).alias("_t"),
        *[F.min(F.when(F.col("roi") <= s, at)).alias(f"_s{i}") for i, s in enumerate(order)],
        F.min(F.struct("sec", "tick_id", "vol")).alias("_first"),
    )
    t = F.col("_t")
    best = F.coalesce(*[F.when(t.isNotNull() & (F.col(f"_s{i}").isNull() | (t < F.col(f"_s{i}"))), F.lit(s)) for i, s in enumerate(order)])
    loosest_hit = F.col(f"_s{len(order) - 1}").isNotNull()
    return g.where(t.isNotNull() | loosest_hit).select(
        "trade_id", minutes_since_open(F.col("_first.sec"), session).alias("minutes"), F.col("_first.vol").alias("vol"),
        F.coalesce(best, F.lit(order[0])).alias("optimal_sl"),
    )


def success_label(path: DataFrame, hold: float = 0.6, sl: float = -0.4) -> DataFrame:
    """1 if roi >= hold comes first (or together), 0 if roi <= sl comes first, null for neither."""
    at = F.struct("sec", "tick_id")
    g = path.groupBy("trade_id").agg(F.min(F.when(F.col("roi") >= hold, at)).alias("_t"), F.min(F.when(F.col("roi") <= sl, at)).alias("_s"))
    t, s = F.col("_t"), F.col("_s")
    return g.select("trade_id", F.when(t.isNotNull() & (s.isNull() | (t <= s)), 1).when(s.isNotNull(), 0).cast("int").alias("label"))


def target_training_set(path: DataFrame, min_roi: float = 0.3, minutes: int = 10, session: SessionSpec = MARKET_HOURS) -> DataFrame:
    """Samples every ``minutes`` of trades that reached ``min_roi``, labeled with the best return
    still to come. ``path`` is a stop-state path with ``vol``."""
    peak = F.max("roi").over(Window.partitionBy("trade_id"))
    able = path.withColumn("_peak", peak).where(F.col("_peak") >= min_roi)
    return paths.sample_every(paths.best_future_roi(able), minutes, session).select(
        "trade_id", "minutes", "vol", F.col("best_future").alias("roi")
    )


def sweep_report(best: DataFrame, names: Sequence[str], section: str) -> DataFrame:
    """Ranked rows with the parameters as a rounded 'a|b|c' key, and the best row of each section."""
    from tickloom.functions.columns import round_key

    params = [n for n in NAMES if n in best.columns]
    key = round_key(F.concat_ws("|", *[F.col(n).cast("string") for n in [*names, *params]]))
    return best.select(F.col(section).alias("section"), "rank", key.alias("key"), "sum", "n", "wins", "losses", "neither", "avg", (F.col("rank") == 1).alias("best_of_section"))
