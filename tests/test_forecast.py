import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabscope.operators import forecast as FC
from tabscope.operators import series as TS


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_node_tables_reproduce_spark_predictions(spark, kind):
    est = (RandomForestRegressor(numTrees=15, maxDepth=4, seed=42) if kind == "forest"
           else GBTRegressor(maxIter=8, maxDepth=3, stepSize=0.1, seed=42))
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["label"] = 2 * pdf["a"] - pdf["b"] ** 2 + rng.normal(scale=0.1, size=300)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))
    model = est.setLabelCol("label").fit(df)
    table = FC._node_table(model, spark)
    pred = model.transform(df).select("a", "b", "prediction").toPandas()
    mine = [FC._eval_trees(table, np.array([a, b])) for a, b in zip(pred["a"], pred["b"])]
    assert np.allclose(mine, pred["prediction"], rtol=1e-9, atol=1e-9)


def test_arima_recovers_ar_coefficient():
    rng = np.random.default_rng(1)
    d = [0.0]
    for _ in range(1500):
        d.append(0.6 * d[-1] + rng.normal())
    y = np.cumsum(d)
    phi, theta, _, _ = FC.arima_fit(y)
    assert abs(phi - 0.6) < 0.1 and abs(theta) < 0.15
    assert len(FC.arima_predict(y, 5)) == 5


def test_forecast_bundle_per_key(spark):
    rows = []
    for k, slope in [("a", 1.0), ("b", -1.0)]:
        for i in range(60):
            rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100 + slope * i))
    df = spark.createDataFrame(rows, "k string, t timestamp, v double")
    out = FC.forecast(df, "t", "v", keys=["k"], models=["NaiveLast", "ARIMA"])
    choice = {r["k"]: r["model"] for r in out["choice"].collect()}
    assert set(choice) == {"a", "b"} and set(choice.values()) <= {"NaiveLast", "ARIMA"}
    pts = out["points"].where("horizon = '1w'").orderBy("k", "step").toPandas()
    assert len(pts) == 14 and pts["bucket"].iloc[0] == pd.Timestamp("2024-03-01")
    # a linear trend is extrapolated by ARIMA(1,1,1) far better than carried forward
    assert choice["a"] == "ARIMA"


def test_lag_folds_follow_the_series_length_and_scale_by_training_rows(spark):
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), float(i + 1), "D", "D") for i in range(32)]
    ser = spark.createDataFrame(rows, "k string, bucket date, value double, frequency string, unit string")
    bt = FC.ml_backtest(ser, ["k"], ["RandomForest"]).toPandas()
    assert bt.groupby("fold").size().tolist() == [7, 7, 7]  # 29 lag rows in the 3 folds of 32 buckets
    # the last training row is the best a tree can say about a rising line: no look at the test window's scale
    first = bt[bt["fold"] == 0]
    assert np.allclose(first["y"].min(), 12) and (first["yhat"] <= 11 + 1e-9).all()


def test_a_candidate_that_fails_is_left_out(spark, monkeypatch):
    start = dt.date(2024, 1, 1)
    ser = spark.createDataFrame([(start + dt.timedelta(days=i), float(i % 5), "D", "D") for i in range(30)],
                                "bucket date, value double, frequency string, unit string")

    def broken(model, final):
        raise ValueError("no estimator")

    monkeypatch.setattr(FC, "_estimator", broken)
    assert FC.ml_backtest(ser, [], ["XGBoost"]).count() == 0 and FC.final_models(ser, [], ["XGBoost"]) == {}
    assert {r["model"] for r in FC.backtest(ser, [], ["NaiveLast", "XGBoost"]).collect()} == {"NaiveLast"}


def test_pooled_folds_never_see_later_rows_of_any_series(spark):
    """Two series of one shape, the other 60 days ahead: a model that saw the leading series' later dates would know the
    lagging one's jumps. No training row is as late as any test row, so the jump stays unknown."""
    start = dt.date(2024, 1, 1)
    value = lambda t: 1000.0 if t >= 140 else 10.0 + t % 3  # noqa: E731 - a jump on one date in both series
    rows = [("lead", start + dt.timedelta(days=t), value(t), "D", "D") for t in range(200)]
    rows += [("late", start + dt.timedelta(days=t), value(t), "D", "D") for t in range(100, 180)]
    ser = spark.createDataFrame(rows, "k string, bucket date, value double, frequency string, unit string")
    folds = FC.pooled_folds(ser, ["k"]).toPandas()
    for _, fold in folds.groupby("fold"):
        test = fold[(fold["r"] >= fold["test_start"]) & (fold["r"] < fold["test_end"])]
        train = fold[fold["bucket"] < fold["cut"]]
        assert train["bucket"].max() < test["bucket"].min() and set(test["k"]) == {"lead", "late"}
    assert folds[folds["k"] == "late"].groupby("fold")["r"].size().tolist() == [73, 73, 73]
    bt = FC.ml_backtest(ser, ["k"], ["RandomForest"]).toPandas()
    first = bt[(bt["fold"] == 0) & (bt["y"] == 1000.0)]
    assert len(first) and (first["yhat"] < 500).all()  # before the cut nothing had jumped
