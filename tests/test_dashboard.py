import datetime as dt

from tabscope.operators import advice as A
from tabscope.operators import dashboard as D


def sales(spark):
    rows = [(dt.datetime(2024, 1, 7) + dt.timedelta(weeks=i), ["Ege", "Akdeniz", "Marmara"][i % 3], 1000.0 + i,
             10 + i % 5) for i in range(12)]
    return spark.createDataFrame(rows, "date timestamp, region string, sales double, units long")


def test_kpis_and_margin(spark):
    df = sales(spark)
    k = D.kpis(df).toPandas()
    assert k["id"].tolist() == ["row_count", "sum_sales", "mean_sales", "sum_units", "mean_units"]
    k2 = D.kpis(df, intent="profit_loss").toPandas()
    assert k2["id"].tolist()[-1] == "margin_proxy"


def test_bar_pie_histogram_filters(spark):
    df = sales(spark)
    bar = D.bar_data(df, "region", "sales", k=2).toPandas()
    assert len(bar) == 2 and bar["sales"].is_monotonic_decreasing
    pie = D.pie_data(df, "region", "sales").toPandas()
    assert pie["region"].tolist() == ["Akdeniz", "Ege", "Marmara"]
    h = D.histogram(df, "units", bins=5).toPandas()
    assert h["count"].sum() == 12
    f = D.apply_filters(df, {"region": ["Ege"], "missing": ["x"]}, ("date", "2024-01-07", "2024-02-04"))
    assert f.count() == 2
    assert D.date_bounds(df).first()["min_date"] == dt.date(2024, 1, 7)


def test_chart_and_model_advice(spark):
    df = sales(spark)
    charts = [r["chart"] for r in A.chart_advice(df).where("advice = 'recommend'").collect()]
    # every non-numeric column counts as categorical, so the date (12 values) is the bar/pie axis
    assert charts == ["line", "area", "bar", "scatter", "heatmap", "histogram"]
    avoid = [r["chart"] for r in A.chart_advice(df).where("advice = 'avoid'").collect()]
    assert avoid == ["pie", "3d_pie"]
    types = [r["type"] for r in A.model_advice(df).collect()]
    assert types[0] == "Forecasting"
    empty = A.chart_advice(df).where("advice = 'avoid'")
    assert [r["chart"] for r in D.chart_specs(df, empty).orderBy("ord").collect()] == ["line", "bar", "scatter", "heatmap"]
    bare = df.sparkSession.createDataFrame([("a",)], "s string")
    assert [r["chart"] for r in A.chart_advice(bare).collect()] == ["table", "3d_pie"]
    assert [r["type"] for r in A.model_advice(bare).collect()] == ["Keşifsel Analiz"]


def test_map_points_by_name(spark):
    df = spark.createDataFrame([(41.0, 29.0), (None, 30.0)], "Enlem double, Boylam double")
    assert D.map_points(df).count() == 1


def test_scatter_sample_and_map_grid(spark):
    """A pair held by a third of the rows comes in proportion; a grid counts the points of a cell."""
    df = spark.createDataFrame([(1.0, 2.0)] * 300 + [(float(i), None if i % 5 else 1.0) for i in range(600)], "a double, b double")
    got = [tuple(r) for r in D.scatter_data(df, "a", "b", max_points=90).collect()]
    assert len(got) == 90 and got.count((1.0, 2.0)) == 30
    assert sorted(got, key=str) == sorted((tuple(r) for r in D.scatter_data(df.repartition(5), "a", "b", max_points=90).collect()), key=str)
    assert D.scatter_data(df, "a", "b", max_points=900).count() == 900
    points = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    assert D.map_points(points).columns == ["lat", "lon"] and D.map_points(points).count() == 3
    assert {(r["lat"], r["lon"], r["count"]) for r in D.map_grid(points).collect()} == {(1.0, 2.0, 2), (3.0, 4.0, 1)}
