import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import dist
from tabscope.operators import stats as S


def test_distribution_tails():
    assert math.isclose(dist.t_sf2(2.0, 10), 0.0733880347707, rel_tol=1e-9)
    assert math.isclose(dist.t_ppf(0.975, 10), 2.228138851986, rel_tol=1e-9)
    assert math.isclose(dist.f_sf(3.0, 2, 20), 0.0725381502864, rel_tol=1e-9)
    assert math.isclose(dist.norm_ppf(0.975), 1.959963984540, rel_tol=1e-9)


def test_descriptive_skew_kurt_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 7.0, 11.0, 4.0]
    df = spark.createDataFrame([(v, 5.0) for v in vals], "x double, k double")
    out = S.descriptive_stats(df).toPandas().set_index("column_name")
    s = pd.Series(vals)
    assert math.isclose(out.loc["x", "skew"], s.skew(), rel_tol=1e-9)
    assert math.isclose(out.loc["x", "kurtosis"], s.kurt(), rel_tol=1e-9)
    assert out.loc["k", "skew"] == 0.0 and out.loc["k", "kurtosis"] == 0.0


def test_welch_and_anova(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0]
    b = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 15.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = S.welch_t(df).first()
    m1, m2, v1, v2 = np.mean(a), np.mean(b), np.var(a, ddof=1), np.var(b, ddof=1)
    t = (m1 - m2) / math.sqrt(v1 / 7 + v2 / 7)
    assert math.isclose(r["statistic"], t, rel_tol=1e-9)
    groups = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g1", 3.0), ("g2", 4.0), ("g2", 5.0), ("g2", 6.0),
                                    ("g3", 1.0)], "g string, v double")
    an = S.anova(groups, "g", "v").first()
    assert an["k"] == 2 and math.isclose(an["statistic"], 13.5, rel_tol=1e-9)


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 3 + 2 * x1 - 0.5 * x2
    df = spark.createDataFrame(pd.DataFrame({"x1": x1, "x2": x2, "y": y}))
    co = {r["term"]: r["coefficient"] for r in S.ols(df, target="y").collect()}
    assert math.isclose(co["intercept"], 3, abs_tol=1e-8) and math.isclose(co["x1"], 2, abs_tol=1e-8)


def test_trend_over_all_points_and_downsampling_match_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 12001
    dates = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 4000, n), unit="D")
    y = rng.normal(size=n).round(1) + np.arange(n) * 0.001
    pdf = pd.DataFrame({"d": dates, "y": y})
    df = spark.createDataFrame(pdf)
    out = S.trend(df, "d", "y").first()
    s = pdf.sort_values(["d", "y"])["y"].to_numpy()
    x = np.arange(n)
    assert out["n"] == n and math.isclose(out["slope"], np.polyfit(x, s, 1)[0], rel_tol=1e-6)
    assert math.isclose(out["r"], np.corrcoef(x, s)[0, 1], rel_tol=1e-6)
    kept = s[::n // 5000]
    thin = S.downsampled_series(df, "d", "y").orderBy("x").toPandas()
    assert thin["x"].tolist() == list(range(len(kept))) and np.allclose(thin["y"], kept)


def test_shapiro_and_adf_behave():
    rng = np.random.default_rng(5)
    w, p = S.shapiro_wilk(rng.normal(size=300))
    assert 0.98 < w <= 1.0 and p > 0.01
    w2, p2 = S.shapiro_wilk(rng.exponential(size=300))
    assert p2 < 1e-4
    stat, p_noise, *_ = S.adf_test(rng.normal(size=400))
    assert p_noise < 0.05  # stationary at the 5 % level used by the reference
    stat, p_walk, *_ = S.adf_test(np.cumsum(rng.normal(size=400)))
    assert p_walk > 0.05


def test_seeded_sample_bounded(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("v"))
    out = S.seeded_sample(df, ["v"], 500).toPandas()
    assert len(out) == 500 and out["v"].nunique() == 500


def test_statistics_suite_runs_as_a_whole(spark):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"g{i % 3}", float(i % 17), float(i * i % 23)) for i in range(60)]
    df = spark.createDataFrame(rows, "day timestamp, grp string, x double, y double")
    out = S.statistics(df)
    assert {"descriptive", "normality", "t_test", "anova", "trend", "stationarity", "confidence_intervals"} <= set(out)
    assert all(frame.count() > 0 for frame in out.values())


def test_spearman_with_missing_values_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n).astype(float), "b": rng.normal(size=n), "c": rng.normal(size=n),
                        "hot": np.where(rng.random(n) < 0.4, 1.0, rng.normal(size=n)), "same": 3.0, "none": np.nan})
    pdf["c"] += pdf["a"] / 10
    pdf.loc[rng.random(n) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "c"] = np.nan
    pdf.loc[pdf["a"] > 30, "hot"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.corr(method="spearman", min_periods=2)
    got = S.spearman(df, digits=None).collect()
    assert len(got) == 36
    for r in got:
        w = want.loc[r["a"], r["b"]]
        both = int((pdf[r["a"]].notna() & pdf[r["b"]].notna()).sum())
        assert r["n"] == both
        assert (r["r"] is None and math.isnan(w)) or math.isclose(r["r"], w, rel_tol=1e-9, abs_tol=1e-12)


def test_correlations_of_many_columns(spark):
    """200 columns with missing values: 9 * columns^2 sums, one scan."""
    from tabscope.operators import profile as P

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(200, 200)), columns=[f"c{i}" for i in range(200)]).mask(rng.random((200, 200)) < 0.1)
    want = pdf.corr()
    got = P.pearson(spark.createDataFrame(pdf)).toPandas().pivot(index="i", columns="j", values="r").to_numpy()
    assert np.allclose(got, want.to_numpy(), atol=1e-9)


def test_adf_over_blocks_matches_one_regression(spark, monkeypatch):
    """All points of long and short series, in blocks with a halo, with ties, a null key and one series without a key."""
    monkeypatch.setattr(S, "ADF_BLOCK", 128)
    rng = np.random.default_rng(8)
    parts = []
    for key, n in (("walk", 1500), ("noise", 900), (None, 128), ("edge", 256), ("short", 12), ("tiny", 9)):
        y = np.cumsum(rng.normal(size=n)) if key == "walk" else rng.normal(size=n).round(1)
        parts.append(pd.DataFrame({"k": key, "d": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, n // 2 + 1, n), unit="D"), "y": y}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(6)
    got = {r["k"]: r for r in S.stationarity(df, "d", "y", keys=["k"]).collect()}
    assert set(got) == {"walk", "noise", None, "edge", "short"}
    for key, r in got.items():
        own = pdf[pdf["k"].isna()] if key is None else pdf[pdf["k"] == key]
        values = own.sort_values(["d", "y"])["y"].to_numpy()
        stat, p, lag, _ = S.adf_test(values)
        assert (r["n"], r["lag"]) == (len(values), lag)
        assert math.isclose(r["statistic"], stat, rel_tol=1e-7) and math.isclose(r["p_value"], p, rel_tol=1e-6, abs_tol=1e-12)
    whole = S.stationarity(df, "d", "y").first()
    assert math.isclose(whole["statistic"], S.adf_test(pdf.sort_values(["d", "y"])["y"].to_numpy())[0], rel_tol=1e-7)


def test_seeded_sample_orders_only_buckets_with_a_taken_position(spark, monkeypatch):
    """The sample is the plain one, by position in order of the hash, without an order of all values (F1, F2)."""
    import hashlib

    monkeypatch.setattr(S, "prefix_sum", lambda *a, **k: pytest.fail("all values put in order"))
    values = [float(i) for i in range(3000)] + [7.0] * 4000 + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = sorted(r["v"] for r in S.seeded_sample(df, ["v"], 70).collect())
    held = sorted((v for v in values if v is not None), key=lambda v: (hashlib.md5(f"42|v|{v}".encode()).hexdigest(), v))
    assert got == sorted(held[i * len(held) // 70] for i in range(70))
    assert sorted(r["v"] for r in S.seeded_sample(df, ["v"], 9000).collect()) == sorted(held)


def test_suite_orders_its_series_once(spark, monkeypatch):
    """Trend and stationarity read the same positions (F1, F2)."""
    from tabscope.operators import ordered

    sorts, own = [], ordered._ranged
    monkeypatch.setattr(ordered, "_ranged", lambda df, group, order, parts: sorts.append(order) or own(df, group, order, parts))
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"d": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(300) // 2, unit="D"), "y": rng.normal(size=300).round(2)})
    df = spark.createDataFrame(pdf)
    out = S.statistics(df, date_col="d")
    assert len([order for order in sorts if "d" in order]) == 1
    got, values = out["stationarity"].first(), pdf.sort_values(["d", "y"])["y"].to_numpy()
    assert math.isclose(got["statistic"], S.adf_test(values)[0], rel_tol=1e-7)
    assert math.isclose(out["trend"].first()["slope"], np.polyfit(np.arange(300), values, 1)[0], rel_tol=1e-7)


def test_adf_sends_a_long_run_as_one_row_per_block(spark, monkeypatch):
    """A value that fills several blocks is spread over them as runs, not as points of one task (F1, F2)."""
    monkeypatch.setattr(S, "ADF_BLOCK", 64)
    rng = np.random.default_rng(9)
    y = np.concatenate([rng.normal(size=150).round(2), np.full(400, 9.5), rng.normal(size=130).round(2)])
    day = np.concatenate([np.arange(150), np.full(400, 150), np.arange(151, 281)])
    df = spark.createDataFrame(pd.DataFrame({"d": pd.Timestamp("2024-01-01") + pd.to_timedelta(day, unit="D"), "y": y})).repartition(4)
    seen, gram = [], S._lagged_gram
    monkeypatch.setattr(S, "_lagged_gram", lambda runs, keys: seen.append(runs.count()) or gram(runs, keys))
    got = S.stationarity(df, "d", "y").first()
    assert seen == [281]
    stat, p, lag, _ = S.adf_test(y)
    assert (got["n"], got["lag"]) == (680, lag) and math.isclose(got["statistic"], stat, rel_tol=1e-7)
