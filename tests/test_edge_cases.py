"""Edge cases listed in FIXTURES.md, exercised across operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tabscope.operators import advice, clean, dashboard, intent, profile, roles, series, stats
from tabscope.sources import delimited, tables


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.overview(df).first()["n_rows"] == 0
    assert profile.missing(df).where("n_missing > 0").count() == 0
    assert clean.validation(df).first()["empty_table"] is True
    assert profile.numeric_summary(df).first()["count"] == 0
    assert dashboard.kpis(df).count() == 1  # only the row count; the all-null numeric is skipped


def test_single_row_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0)], "x double, k double")
    s = profile.numeric_summary(df).toPandas().set_index("column_name")
    assert s.loc["x", "p50"] == 1.0 and (s.loc["x", "std"] is None or math.isnan(s.loc["x", "std"]))
    const = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "x double, k double")
    r = profile.pearson(const).toPandas().set_index(["a", "b"])["r"]
    assert r[("x", "k")] is None or math.isnan(r[("x", "k")])
    d = stats.descriptive_stats(const).toPandas().set_index("column_name")
    assert d.loc["k", "skew"] == 0.0


def test_all_null_and_nan_next_to_null(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, None), (None, 3.0)], "a double, b double")
    m = profile.missing(df).toPandas().set_index("column_name")["n_missing"]
    assert m["a"] == 3 and m["b"] == 2
    assert clean.validation(df).first()["all_null_columns"] == "a"
    out = profile.outliers(df).toPandas()
    assert out["column_name"].tolist() == ["b"]  # all-null column skipped
    imputed = clean.impute_median(df).collect()
    assert all(r["a"] is None for r in imputed) and all(r["b"] == 3.0 for r in imputed)


def test_null_group_key_and_ties(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "g string, v double")
    bar = dashboard.bar_data(df, "g", "v").collect()
    assert (bar[0]["g"], bar[0]["v"]) == ("a", 3.0) and bar[1]["g"] is None and bar[1]["v"] == 3.0
    pie = dashboard.pie_data(df, "g", "v").collect()
    assert pie[-1]["g"] is None  # NULL key last
    modes = clean.column_modes(spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string"), ["s"])
    assert modes.first()["mode"] == "a"


def test_boolean_is_not_numeric_and_integer_winsorize(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (True, 3), (True, 4), (False, 100)], "f boolean, n int")
    from tabscope.functions.columns import numeric_columns
    assert numeric_columns(df) == ["n"]
    vals = sorted(r["n"] for r in clean.winsorize(df).collect())
    assert vals[-1] == 7.0 and isinstance(vals[0], float)


def test_leap_day_year_end_and_equal_timestamps(spark):
    rows = [(dt.datetime(2024, 2, 29, 10),), (dt.datetime(2024, 12, 31, 23, 59),), (dt.datetime(2024, 12, 31, 23, 59),)]
    df = spark.createDataFrame(rows, "t timestamp")
    b = sorted(r["b"] for r in df.select(series.bucket_of(F.col("t"), "MS").alias("b")).distinct().collect())
    assert b == [dt.datetime(2024, 2, 1), dt.datetime(2024, 12, 1)]
    y = df.select(series.step_after(F.col("t"), "YS", 1).alias("n")).orderBy("n").first()["n"]
    assert y == dt.datetime(2025, 2, 28, 10)  # leap day + 1 year clamps to Feb 28
    f = series.detect_frequency(df, "t").first()
    assert f["n_dates"] == 2 and f["frequency"] == "unknown"


def test_few_points_are_reported_not_fatal(spark):
    rows = [(dt.datetime(2024, 1, d), float(d)) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "t timestamp, v double")
    assert series.time_series(df, "t", "v").count() == 0
    st = series.series_status(df, "t", "v").first()
    assert st["available"] is False and st["reason"] == "fewer than 12 points"
    assert stats.trend(df, "t", "v").count() == 0  # fewer than 10 points


def test_turkish_letters_in_intent_and_one_column_file(spark, tmp_path):
    q = spark.createDataFrame([("SATIŞ ANALİZİ",), ("kâr-zarar özeti",)], "q string")
    p = {r["query"]: r["primary_intent"] for r in intent.primary_intent(q, "q").collect()}
    assert p["kâr-zarar özeti"] == "profit_loss"
    f = tmp_path / "one.csv"
    f.write_text("amount\n1\n2\n3\n", encoding="utf-8")
    df = tables.read_table(spark, str(f))
    assert df.columns == ["amount"] and df.count() == 3
    assert delimited.detect_csv(spark, str(f))["delimiter"] == ","


def test_model_advice_without_signals(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert [r["type"] for r in advice.model_advice(df).collect()] == ["Keşifsel Analiz"]
    charts = [r["chart"] for r in advice.chart_advice(df).collect()]
    assert charts == ["table", "3d_pie"]


def test_missing_values_in_correlations(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 5, 300)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 3, 300), "c": np.full(300, 7.1), "d": rng.normal(0, 1, 300)})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "d"] = np.nan
    df = spark.createDataFrame(pdf)
    for kind, want in (("corr", pdf.corr()), ("cov", pdf.cov())):
        got = profile.pair_moments(df, list(pdf.columns), kind).toPandas()
        for r in got.itertuples():
            w = want.loc[r.a, r.b]
            assert (pd.isna(w) and pd.isna(r.value)) or abs(r.value - w) < 1e-6
            assert r.n == int((pdf[r.a].notna() & pdf[r.b].notna()).sum())


def test_mixed_date_formats_short_spans_and_samples(spark):
    mixed = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 10)] + [("05/02/2024",), ("none",)], "t string")
    got = [r["t"] for r in roles.coerce_datetimes(mixed, {"t": "yyyy-MM-dd"}).collect()]
    assert sum(g is None for g in got) == 1 and any(g and (g.month, g.day) == (2, 5) for g in got)
    day = spark.createDataFrame([(f"2024-01-01 {i:02d}:00:00", 1.0) for i in range(20)], "t string, v double").selectExpr(
        "cast(t as timestamp) t", "v")
    assert series.series_status(day, "t", "v").first()["available"] is False
    rows = spark.range(5000).selectExpr("cast(id % 7 as double) v")
    one, two = (sorted(r["v"] for r in stats.seeded_sample(rows.repartition(n), ["v"], 70).collect()) for n in (3, 8))
    assert one == two and len(one) == 70 and all(9 <= one.count(v) <= 11 for v in range(7))
