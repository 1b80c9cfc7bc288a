import datetime as dt

from pyspark.sql import functions as F

from tabscope.operators import series as TS


def test_weekly_bucket_is_sunday_including_sunday_morning(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 10),), (dt.datetime(2024, 1, 8, 1),), (dt.datetime(2024, 1, 6),)],
                               "t timestamp")
    out = sorted(r["b"] for r in df.select(TS.bucket_of(F.col("t"), "W").alias("b")).collect())
    assert out == [dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 14)]


def test_detect_frequency_labels(spark):
    def freq(days):
        base = dt.datetime(2020, 1, 1)
        rows = [(base + dt.timedelta(days=d),) for d in days]
        return TS.detect_frequency(spark.createDataFrame(rows, "t timestamp"), "t").first()["frequency"]

    assert freq(range(20)) == "daily"
    assert freq(range(0, 140, 7)) == "weekly"
    assert freq([0, 31, 60, 91, 121, 152]) == "monthly"
    assert freq([0, 365, 730, 1096]) == "yearly"
    assert freq([0, 1]) == "unknown"


def test_gap_fill_zero_and_interpolate(spark):
    rows = [(dt.datetime(2024, 1, d), float(d)) for d in range(1, 21) if d not in (5, 6)]
    df = spark.createDataFrame(rows, "t timestamp, v double")
    s = TS.time_series(df, "t", "v", frequency="D").orderBy("bucket").toPandas()
    assert len(s) == 20 and s.loc[4, "value"] == 0.0
    n = TS.time_series(df, "t", "v", frequency="D", fill="null")
    it = TS.interpolate(n).orderBy("bucket").toPandas()
    assert it.loc[4, "value"] == 5.0 and it.loc[5, "value"] == 6.0


def test_horizon_steps(spark):
    f = spark.createDataFrame([("W",), ("MS",), ("YS",), ("D",)], "unit string")
    out = TS.horizon_steps(f).toPandas()
    steps = {u: out[out.unit == u].sort_values("h_ord")["steps"].tolist() for u in ["W", "MS", "YS", "D"]}
    assert steps["W"] == [1, 4, 13, 26, 52] and steps["MS"] == [1, 1, 3, 6, 12]
    assert steps["YS"] == [1, 1, 1, 1, 1] and steps["D"] == [7, 30, 90, 180, 365]


def test_folds_and_naive_backtest(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    s = TS.time_series(spark.createDataFrame(rows, "t timestamp, v double"), "t", "v", frequency="D")
    bt = TS.naive_backtest(s).orderBy("bucket").toPandas()
    # n = 40 -> k = 3 folds of 10 rows: tests 10..39, prediction = value before each window
    assert len(bt) == 30 and bt["yhat"].tolist() == [9.0] * 10 + [19.0] * 10 + [29.0] * 10
    m = TS.metrics(TS.naive_backtest(s)).first()
    assert abs(m["mae"] - 5.5) < 1e-12


def test_one_long_series_in_blocks(spark, monkeypatch):
    """Positions, lags, interpolation, recent points and the backtest do not depend on how a series is cut into blocks."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    for unit, offset in (("D", "D"), ("W", "7D"), ("MS", "MS"), ("YS", "YS")):
        n = 150
        value = pd.Series(rng.normal(size=n)).mask(rng.random(n) < 0.4)
        value[:5], value[60:95], value[-3:] = np.nan, np.nan, np.nan
        pdf = pd.DataFrame({"bucket": pd.date_range("2000-01-01", periods=n, freq=offset), "value": value, "unit": unit})
        whole = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).repartition(3)
        monkeypatch.setattr(TS, "BLOCK", 16)
        got = TS.interpolate(whole).orderBy("bucket").toPandas()["value"].to_numpy()
        assert np.allclose(got, value.interpolate(limit_direction="both").to_numpy())
        filled = whole.fillna(0.0)
        plain = pdf["value"].fillna(0.0).to_numpy()
        lags = TS.lag_features(filled).orderBy("idx").toPandas()
        assert lags["idx"].tolist() == list(range(7, n))
        assert all(np.allclose(lags[f"lag_{k}"], plain[7 - k:n - k]) for k in range(1, 8))
        assert TS.recent(filled, max_points=20).toPandas()["bucket"].min() == pdf["bucket"].iloc[n - 20]
        bt = TS.naive_backtest(filled).orderBy("bucket").toPandas()
        assert len(bt) == 111 and np.allclose(bt["yhat"], np.repeat(plain[[38, 75, 112]], 37))
