import datetime as dt
import json

from pyspark.sql import functions as F

import tabscope.plans.analyze as analyze_module
from tabscope.plans.analyze import analyze, summary
from tabscope.sources import tables


def test_failing_section_is_reported_and_others_run(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i) * 1.5) for i in range(30)],
                               "order_id int, segment string, sales double")
    res = analyze(df, "Satış analizi yap", "inline", with_forecast=True, forecast_models=["NaiveLast"])
    errors = {r["section"]: r["error"] for r in res["errors"].collect()}
    assert "forecast" in errors  # no date column: reported, not raised
    assert res["intent"].first()["primary_intent"] == "sales_analysis"
    assert res["kpis"].count() >= 1 and res["report"].count() > 5
    lines = summary({k: res[k] for k in ["kpis", "model_advice", "errors"]}).collect()
    assert {r["table"] for r in lines} == {"kpis", "model_advice", "errors"}
    assert all(isinstance(json.loads(r["row"]), dict) for r in lines)


def test_every_section_runs_and_failures_at_run_time_are_reported(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), float(i + i % 7), float(3 * i + i % 5), "ab"[i % 2], "xyz"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "t timestamp, sales double, cost double, g string, h string")
    res = analyze(df, "Satış analizi yap", "inline", forecast_models=["NaiveLast", "ARIMA"])
    assert res["errors"].collect() == []
    assert {"notes", "forecast.points", "statistics.trend", "statistics.stationarity", "profile.overview", "filters"} <= set(res)
    lines = [(r["section"], r["ord"]) for r in res["report"].collect()]
    assert len(lines) == len(set(lines)) and ("technical", 6) in lines and ("executive", 5) in lines and ("insights", 7) in lines
    assert ("technical", 12) not in lines

    failing = df.select(F.raise_error(F.lit("late")).cast("double").alias("value"))
    monkeypatch.setattr(analyze_module.dashboard, "kpis", lambda d, **known: failing)
    res = analyze(df, with_forecast=False)
    assert [r["section"] for r in res["errors"].collect()] == ["kpis"] and "kpis" not in res
    assert summary(res).count() > 20


def test_read_and_write_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    for fmt in ["parquet", "json", "csv"]:
        path = str(tmp_path / f"out_{fmt}")
        tables.write_table(df, path, fmt=fmt)
        back = tables.read_table(spark, path, fmt=fmt, **({"header": "true"} if fmt == "csv" else {}))
        assert sorted(str(r["s"]) for r in back.collect()) == ["a", "b"]
    try:
        tables.read_table(spark, str(tmp_path / "x.xls"))
        raise AssertionError("legacy .xls must be refused")
    except tables.LoadError:
        pass


def test_shared_values_give_the_same_sections(spark):
    """Every section from shared aggregates equals the section that scans for itself; missing values, ties, no values."""
    from tabscope.operators import clean, dashboard, profile, stats
    from tabscope.plans.shared import Shared

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i % 20), None if i % 7 == 0 else float(i % 11), float("nan") if i % 5 == 0 else i * 1.5, None, i % 4, "abc"[i % 3] if i % 6 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "t timestamp, sales double, cost double, none double, q int, g string").repartition(4)
    s = Shared(df)
    bundle, suite = profile.profile(df, s), stats.statistics(df, shared=s)
    cases = [(bundle["overview"], profile.overview(df)), (bundle["missing"], profile.missing(df)), (bundle["volume"], profile.data_volume(df)),
             (bundle["numeric_summary"], profile.numeric_summary(df)), (bundle["categorical_summary"], profile.categorical_summary(df)),
             (bundle["outliers"], profile.outliers(df)), (bundle["duplicates"], profile.duplicate_rows(df)), (suite["descriptive"], stats.descriptive_stats(df)),
             (suite["pearson"], profile.pearson(df, digits=4)), (suite["covariance"], stats.covariance(df)), (clean.plan(df, s.one, s.duplicates), clean.plan(df)),
             (dashboard.kpis(df, one=s.one), dashboard.kpis(df)), (dashboard.filter_options(df, freq=s.frequencies), dashboard.filter_options(df)),
             (dashboard.date_bounds(df, one=s.one), dashboard.date_bounds(df))]
    for shared, own in cases:
        assert shared.columns == own.columns
        rounded = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in map(tuple, d.collect()))
        assert [tuple(map(str, r)) for r in rounded(shared)] == [tuple(map(str, r)) for r in rounded(own)]


def test_an_analysis_scans_its_table_a_fixed_number_of_times(spark, tmp_path):
    """Shared values, frequencies and pairs of a table: a few scans, whatever the number of rows and sections; the one-row
    values of many columns are split, each part with columns of its own."""
    from tabscope.plans.shared import Shared

    def scans(columns):
        seen = spark.sparkContext.accumulator(0)
        path = str(tmp_path / f"t{columns}")
        spark.range(64).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(columns)], (F.col("id") % 3).cast("string").alias("g")).coalesce(1).write.parquet(path)
        df = spark.read.parquet(path)

        def count(batches):
            seen.add(1)
            yield from batches

        counted = df.mapInArrow(count, df.schema)
        s = Shared(counted)
        _ = s.row, s.one, s.duplicates.collect(), s.frequencies.collect(), s.pairs("corr").collect(), s.pairs("cov").collect(), s.numeric_summary().collect()
        return seen.value

    assert scans(2) == scans(3) <= 7 and scans(12) <= 11


def test_report_reads_its_table_before_the_lines_are_made(spark, tmp_path):
    """The advice counts distinct values once, not once per line that cites it (F2)."""
    from tabscope.operators.report import report_lines

    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, float(i * i % 7), f"g{i % 3}") for i in range(60)], "a long, price double, g string").write.parquet(path)
    out = report_lines(spark.read.parquet(path), "analyse", "t")
    assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString()
    lines = [(r["section"], r["line"]) for r in out.collect()]
    assert any(s == "executive" and line.startswith("Suggested modelling approach: ") for s, line in lines)
    assert any(s == "next_steps" and line.startswith("Confirm the goal of: ") for s, line in lines)
