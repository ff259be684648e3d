"""M5 from fold sums against fits on the rows, stored models (M8), and a whole retraining (M9) at small settings."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tickloom.operators import ridge, stats
from tickloom.plans import models
from tickloom.session import FULL_DAY, shared_dir, stage
from tickloom.sources.tables import DIAGNOSTIC_COLUMNS


def samples(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i // 3), int(rng.integers(0, 300)), float(rng.uniform(0.1, 1)), float(rng.uniform(-0.5, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "trade_id bigint, minutes int, vol double, roi double").repartition(4)


@pytest.fixture(scope="module")
def folded(spark):
    data, cols = models.roi_samples_in_folds(samples(spark))
    return stage(data.withColumn("s_constant", F.lit(3.0))), [*cols, "s_constant"]


@pytest.mark.parametrize("lam", [1e-3, 0.1, 10.0])
def test_solutions_equal_fits_on_the_rows(spark, folded, lam):
    data, cols = folded
    parts = ridge.moments(data, "fold", cols, "_y", "weight")
    assert sorted(parts) == [0, 1, 2, 3, 4]
    for f in (0, 3):
        mine = ridge.solve(sum(parts.values()) - parts[f], cols, lam)
        train = VectorAssembler(inputCols=cols, outputCol="x").transform(data.where(F.col("fold") != f))
        fit = LinearRegression(featuresCol="x", labelCol="_y", weightCol="weight", regParam=lam, solver="normal").fit(train)
        both = fit.transform(train).select("prediction", mine.predict().alias("mine")).collect()
        assert max(abs(r["prediction"] - r["mine"]) for r in both) < 1e-6
        assert mine.coefficients[-1] == 0


def test_choice_equals_a_fit_per_penalty_and_fold(spark, folded):
    data, cols = folded
    lambdas = (1e-3, 0.05, 1.0, 50.0)
    found = models.fit_max_roi(data, cols, lambdas)
    rows = VectorAssembler(inputCols=cols, outputCol="x").transform(data)
    want = {}
    for lam in lambdas:
        errors = []
        for f in range(5):
            fit = LinearRegression(featuresCol="x", labelCol="_y", weightCol="weight", regParam=lam, solver="normal").fit(rows.where(F.col("fold") != f))
            held = fit.transform(rows.where(F.col("fold") == f))
            errors.append(held.agg(F.sum(F.col("weight") * F.abs(F.expm1("prediction") - F.col("roi"))) / F.sum("weight")).first()[0])
        want[lam] = float(np.mean(errors))
    assert {r["lambda"]: r["mean_score"] for r in found.scores.collect()} == pytest.approx(want, rel=1e-6)
    assert found.penalty == min(want, key=lambda x: (want[x], x))


def test_rows_with_null_inputs_and_empty_tables(spark):
    rows = [(0, 1.0, 2.0, 1.0), (0, None, 1.0, 1.0), (1, 2.0, float("nan"), 1.0), (1, 3.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "fold int, x double, y double, w double")
    got = ridge.moments(df, "fold", ["x"], "y", "w")
    assert {f: m.tolist() for f, m in got.items()} == {0: [[1, 1, 2], [1, 1, 2], [2, 2, 4]], 1: [[2, 6, 10], [6, 18, 30], [10, 30, 50]]}
    assert ridge.moments(df.limit(0), "fold", ["x"], "y", "w") == {}
    flat = ridge.solve(np.array([[2.0, 2, 6], [2, 2, 6], [6, 6, 18]]), ["x"], 0.1)
    assert flat.coefficients == (0.0,) and flat.intercept == pytest.approx(3.0)
    with pytest.raises(ValueError):
        models.fit_max_roi(df.limit(0).withColumnsRenamed({"y": "_y", "w": "weight"}), ["x"])


def test_stored_models(spark):
    store = shared_dir(spark)
    ridge.save_ridge(spark, store, "target", "0.09", ridge.Ridge(("s_hours",), (0.5,), 0.1), 1.1)
    ridge.save_ridge(spark, store, "target", "0.10", ridge.Ridge(("s_hours", "s_log_vol"), (0.25, 2.0), 0.2), 1.2)
    ridge.save_ridge(spark, store, "other", "7.00", ridge.Ridge(("s_hours",), (9.0,), 0.0))
    s = spark.createDataFrame([(1, 60, 0.5), (2, 0, 0.0), (3, 30, None)], "trade_id long, minutes int, vol double")
    got = {r["trade_id"]: (r["max_roi"], r["version_id"]) for r in models.predict_stored(s, store).collect()}
    assert got == {1: (round(1.2 * math.exp(0.2 + 0.25 + 2 * math.log(1.5)) - 1, 2), "0.10"), 2: (round(1.2 * math.exp(0.2) - 1, 2), "0.10"), 3: (None, "0.10")}
    first = models.predict_stored(s, store, version="0.09").collect()
    assert {r["max_roi"] for r in first if r["trade_id"] == 1} == {round(1.1 * math.exp(0.6) - 1, 2)}
    ridge.save_ridge(spark, store, "target", "0.10", ridge.Ridge(("s_hours",), (0.0,), 0.0))
    assert {r["max_roi"] for r in models.predict_stored(s, store).collect()} == {0.0}
    assert ridge.load_ridge(spark, store, "other")[2] == "7.00"
    for args in (("none",), ("target", "5.00")):
        with pytest.raises(ValueError):
            ridge.load_ridge(spark, store, *args)


def test_trade_test(spark):
    rows = [("2024-01-02", "a", 0.5), ("2024-01-02", "b", -1.1), ("2024-01-03", "a", 0.9), ("2024-01-03", "a", 0.0)]
    t = spark.createDataFrame(rows, "trade_date string, ticker string, roi double").withColumn("trade_date", F.to_date("trade_date"))
    r = stats.trade_test(t).first()
    assert tuple(r.asDict()) == DIAGNOSTIC_COLUMNS["trade_test"]
    assert tuple(r) == (4, 0.3, 2, 0.075, 0.0125, 0.15, 0.02, -0.1, 0.15)


def test_retraining_fills_the_trade_test_and_stores_the_target_model(spark):
    rng = np.random.default_rng(2)
    s = samples(spark, 150).withColumn("label", (F.col("roi") > 0.7).cast("int")).withColumn("optimal_sl", F.when(F.col("vol") > 0.5, -0.4).otherwise(-0.2))
    path = [(t, "ab"[t % 2], "2024-01-02", 30_000, 30_000 + 60 * k, 100 * t + k, float(rng.normal(0.02 * k, 0.2)), float(rng.uniform(0.1, 1))) for t in range(12) for k in range(20)]
    path = spark.createDataFrame(path, "trade_id long, ticker string, trade_date string, entry_sec int, sec int, tick_id long, roi double, vol double").withColumn("trade_date", F.to_date("trade_date"))
    past = spark.createDataFrame([("target", "0.14")], "model_name string, v string").select("model_name", F.col("v").cast("decimal(4,2)").alias("version_id"))
    store = shared_dir(spark)
    rows = {r["model_name"]: r for r in models.retrain_all(spark, s.select("trade_id", "minutes", "vol", "label").dropDuplicates(["trade_id"]), s.select("trade_id", "minutes", "vol", "optimal_sl"), s.select("trade_id", "minutes", "vol", "roi"),
                                                            past, path, (0.1, 1.0), (0.1, 1.0), 3, FULL_DAY, store).collect()}
    assert len(rows) == 3 and str(rows["target"]["version_id"]) == "0.15"
    names = [f"trade_test_{n}" for n in DIAGNOSTIC_COLUMNS["trade_test"]]
    assert all(rows["target"][n] is not None for n in names) and rows["target"]["trade_test_trades"] == 12
    assert all(rows["stop loss"][n] is None for n in names)
    assert ridge.load_ridge(spark, store, "target")[2] == "0.15"
