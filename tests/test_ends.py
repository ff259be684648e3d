"""Paths that end with their first sure chain of hits: same results as on whole paths, and few rows."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ends, paths, stats
from tickloom.operators.ends import Hit
from tickloom.session import FULL_DAY, SessionSpec

TRADE = "trade_id long, ticker string, trade_date string, side string, entry_sec int, exit_sec int, entry_price double"
TICK = "ticker string, trade_date string, sec int, tick_id long, price double"


def market(spark, n=300, seed=5, repeated=True):
    """Trades (ids repeat and are null, some prices are null) and ticks of two days, several a second, some NaN or null, none in the last hours of a day."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        entry = rnd.randrange(80_000)
        key = (rnd.randrange(n) if rnd.random() < 0.95 else None) if repeated else i
        rows.append((key, rnd.choice("abc"), rnd.choice(("d1", "d2", None)), rnd.choice(("buy", "short")), entry, entry + rnd.randrange(900), None if rnd.random() < 0.03 else round(rnd.uniform(99.4, 100.6), 2)))
    ticks = [(rnd.choice("ab"), rnd.choice(("d1", "d2")), rnd.randrange(70_000) // 3 * 3, i, rnd.choice([None, float("nan")]) if rnd.random() < 0.01 else round(rnd.gauss(100, 0.8), 2)) for i in range(6000)]
    return spark.createDataFrame(rows, TRADE), spark.createDataFrame(ticks, TICK)


def rows_of(df):
    return sorted(map(str, df.collect()))


def whole_paths(monkeypatch):
    """From now on every path goes to the end of the session."""
    uncut = lambda t, k, session, *_: t.withColumn("_until", F.lit(session.close_sec))
    monkeypatch.setattr(ends, "last_second", uncut)
    monkeypatch.setattr(ends, "target_second", uncut)


@pytest.fixture
def met(monkeypatch):
    """Paths that the operators under test ask for."""
    seen, plain = [], paths._path_until

    def kept(t, k):
        seen.append(plain(t, k))
        return seen[-1]

    monkeypatch.setattr(paths, "_path_until", kept)
    return seen


def few(t, k, path):
    return path.count() < t.join(k, ["ticker", "trade_date"]).where("sec >= entry_sec").count() / 4


def same_on_whole_paths(monkeypatch, job):
    cut = rows_of(job())
    whole_paths(monkeypatch)
    assert cut == rows_of(job()) and cut


@pytest.mark.parametrize("seed", (1, 2))
def test_a_stop_after_the_holding_value_ends_a_path(spark, monkeypatch, met, seed):
    t, k = market(spark, seed=seed, repeated=False)
    path = lambda: paths.stop_state_path(paths.roi_path(t, k, FULL_DAY, over=paths.at_stop()))
    same_on_whole_paths(monkeypatch, path)
    # entries so low that 0.4 percent are never lost: only the later return to the entry ends them
    monkeypatch.undo()
    low = t.where("side = 'buy' and entry_price is not null").withColumn("entry_price", F.lit(98.6))
    calm = k.where("price > 98.3 and not isnan(price)")
    assert few(low, calm, paths.roi_path(low, calm, FULL_DAY, over=paths.at_stop()))


def test_ends_equal_a_plain_search(spark):
    t, k = market(spark, 200, 3)
    ticks, close = sorted(((r.sec, r.ticker, r.trade_date, r.price) for r in k.collect()), key=lambda x: x[0]), 60_000
    chains = [[Hit(0.6), Hit(0.0, up=False, since="exit_sec")], [Hit(since="entry_sec", plus=10_800)], [Hit(-2.5, up=False)]]
    for r in ends.last_second(t, k, SessionSpec(0, close), chains).collect():
        mine = [(s, p) for s, a, d, p in ticks if a == r.ticker and d == r.trade_date and s <= close]
        hits = []
        for chain in chains:
            after = r.entry_sec - 1
            for h in chain:
                start = max(after + 1, r[h.since] + h.plus) if h.since else after + 1
                back = lambda p: None if p is None or p != p or r.entry_price is None else (p - r.entry_price) / r.entry_price * 100 * (1 if r.side == "buy" else -1)
                over = lambda p: h.level is None or back(p) is not None and (back(p) >= h.level + 0.01 if h.up else back(p) <= h.level - 0.01)
                after = next((s for s, p in mine if s >= start and over(p)), None)
                if after is None:
                    break
            hits.append(close if after is None else after)
        assert r._until == min(hits)


@pytest.mark.parametrize("repeated", (True, False))
def test_horizons_need_only_the_path_to_the_last_one(spark, monkeypatch, met, repeated):
    t, k = market(spark, repeated=repeated)
    same_on_whole_paths(monkeypatch, lambda: paths.horizon_roi(t, k, session=FULL_DAY))
    assert few(t, k.where("price is not null"), met[0])


def test_a_horizon_without_a_price_has_the_last_return(spark, monkeypatch):
    t = spark.createDataFrame([(i, "a", "d", "buy", i, i + 10, 100.0) for i in range(6)], TRADE)
    price = lambda s: None if s == 7200 else 101.0 + s / 1e5
    k = spark.createDataFrame([("a", "d", s, s, price(s)) for s in range(0, 20_000, 50)], TICK)
    got = paths.horizon_roi(t, k, session=FULL_DAY).where("trade_id = 0").first()
    assert got["roi_2h"] == round(price(19_950) - 100, 2) and got["roi_3h"] == round(price(10_800) - 100, 2)
    same_on_whole_paths(monkeypatch, lambda: paths.horizon_roi(t, k, session=FULL_DAY))


@pytest.mark.parametrize("repeated", (True, False))
def test_targets_need_only_the_path_to_the_return(spark, monkeypatch, met, repeated):
    t, k = market(spark, repeated=repeated)
    same_on_whole_paths(monkeypatch, lambda: paths.target_attain(t, k, session=FULL_DAY))
    assert few(t, k, met[0])


@pytest.mark.parametrize("repeated", (True, False))
def test_holding_values_need_only_the_path_to_the_last_stop(spark, monkeypatch, met, repeated):
    t, k = market(spark, repeated=repeated)
    over = paths.at_stop(hold=max(stats.HOLD_VALUES))
    path = lambda: paths.roi_path(t, k, FULL_DAY, over=over, shared=True)
    same_on_whole_paths(monkeypatch, lambda: stats.holding_outcomes(path()))
    assert repeated or few(t, k, met[0])


@pytest.mark.parametrize("repeated", (True, False))
def test_a_best_stop_needs_only_the_path_to_the_target(spark, monkeypatch, met, repeated):
    t, k = market(spark, repeated=repeated)
    same_on_whole_paths(monkeypatch, lambda: paths.best_stop_loss(t, k, session=FULL_DAY))
    assert repeated or few(t, k, met[0])


def test_a_target_that_no_day_reaches_needs_only_first_ticks(spark, met):
    t, k = market(spark)
    calm = k.where("price is not null and not isnan(price)")
    met.clear()
    assert {r.best_sl for r in paths.best_stop_loss(t.dropDuplicates(["trade_id"]), calm, 50.0, session=FULL_DAY).collect()} == {None}
    assert met[0].groupBy("trade_id").count().where("count > 5").count() == 0
