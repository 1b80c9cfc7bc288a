import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import profile as P
from tabscope.operators import roles as R


@pytest.fixture()
def small(spark):
    rows = [(1.0, "x", 10), (2.0, "x", 10), (float("nan"), "y", 20), (4.0, None, 40), (10.0, "y", 50)]
    return spark.createDataFrame(rows, "a double, b string, c long")


def test_numeric_summary_matches_pandas(small):
    out = P.numeric_summary(small).toPandas().set_index("column_name")
    exp = pd.Series([1.0, 2.0, None, 4.0, 10.0]).describe()
    assert out.loc["a", "count"] == 4
    for k, col in [("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("mean", "mean"), ("std", "std")]:
        assert math.isclose(out.loc["a", col], exp[k], rel_tol=1e-12)


def test_missing_counts_nan_as_missing(small):
    out = P.missing(small).toPandas().set_index("column_name")
    assert out.loc["a", "n_missing"] == 1 and out.loc["b", "n_missing"] == 1 and out.loc["c", "n_missing"] == 0
    assert out.loc["a", "pct_missing"] == 20.0


def test_duplicates_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "x int, y string")
    r = P.duplicate_rows(df).first()
    assert (r["n_rows"], r["distinct_rows"], r["duplicate_rows"]) == (5, 3, 2)
    empty = spark.createDataFrame([], "x int")
    assert P.duplicate_rows(empty).first()["duplicate_rows"] == 0


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",), (None,)], "s string")
    out = P.top_values(df, k=2).toPandas()
    assert out["value"].tolist() == ["a", "b"] and out["count"].tolist() == [2, 2]


def test_outliers_strict_bounds(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = P.outliers(df).first()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert math.isclose(r["lower"], q1 - 1.5 * (q3 - q1)) and r["n_outliers"] == 1


def test_pearson_constant_column_is_null_and_pairwise(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0), (4.0, 5.0, 8.0)],
                               "a double, k double, b double")
    m = P.pearson(df).toPandas().set_index(["a", "b"])["r"]
    assert m[("a", "k")] is None or math.isnan(m[("a", "k")])
    exp = pd.DataFrame({"a": [1, 2, 3, 4], "b": [2, None, 6, 8]}).corr().loc["a", "b"]
    assert math.isclose(m[("a", "b")], exp, rel_tol=1e-12)


def test_strong_pairs_order(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"),
                                 (F.col("id") % 7).cast("double").alias("z"))
    out = P.strong_pairs(df).toPandas()
    assert out[["a", "b"]].values.tolist()[0] == ["x", "y"] and math.isclose(out["r"].iloc[0], 1.0)


def test_roles_id_target_and_boolean_not_numeric(spark):
    df = spark.createDataFrame([(i, f"C{i % 3}", i * 1.5, i % 2 == 0) for i in range(20)],
                               "order_id int, customer string, sales double, flag boolean")
    roles = R.roles(df).toPandas().set_index("column_name")
    assert bool(roles.loc["order_id", "is_id"]) and not bool(roles.loc["customer", "is_id"])
    assert roles.loc["flag", "kind"] == "boolean"
    assert R.target_rank_map(df) == {"sales": 1, "order_id": 2}
    assert R.resolve_value_column(["order_id", "sales"]) == "sales"


def test_datetime_detection_iso_and_day_first(spark):
    df = spark.createDataFrame([("2024-01-07", "07/01/2024", "x")] * 5 + [("2024-01-14", "14/01/2024", "y")],
                               "iso string, tr string, other string")
    out = R.datetime_columns(df).toPandas().set_index("column_name")
    assert out.loc["iso", "format"] == "yyyy-MM-dd" and out.loc["tr", "format"] == "dd/MM/yyyy"
    assert "other" not in out.index


def test_profile_bundle_all_tables(spark):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 7) + dt.timedelta(weeks=i), ["Ege", "Akdeniz"][i % 2], 7600.0 + 100 * i,
             18 + i % 7, f"C00{i % 6 + 1}") for i in range(52)]
    df = spark.createDataFrame(rows, "date timestamp, region string, sales double, units long, customer_id string")
    bundle = P.profile(df)
    sizes = {k: v.count() for k, v in bundle.items()}
    assert sizes["overview"] == 1 and sizes["types"] == 5 and sizes["missing"] == 5
    assert sizes["numeric_summary"] == 2 and sizes["outliers"] == 2 and sizes["correlations"] == 4
    ov = bundle["overview"].first()
    assert (ov["n_rows"], ov["n_columns"], ov["duplicate_rows"]) == (52, 5, 0)
    assert [r["column_name"] for r in bundle["datetime_columns"].collect()] == ["date"]
    assert bundle["id_columns"].count() == 0  # customer_id: 6 of 52 distinct
    assert [r["column_name"] for r in bundle["target_candidates"].orderBy("target_rank").collect()][:2] == ["sales", "units"]


def test_distinct_counts_and_what_is_counted(spark, monkeypatch):
    """Sketches leave columns out; what is reported is exact, at the thresholds too."""
    from pyspark.sql import functions as F

    from tabscope.operators import roles as R

    n = 3000
    df = spark.range(n).select(
        "id", (F.col("id") % 2999).alias("almost"), F.concat(F.lit("x" * 300), F.least(F.col("id"), F.lit(2699)).cast("string")).alias("code_a"),
        F.least(F.col("id"), F.lit(2698)).cast("string").alias("code_b"), (F.col("id") % 8).cast("string").alias("eight"),
        (F.col("id") % 9).cast("string").alias("nine"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 5).alias("f"),
        F.lit(None).cast("string").alias("none"), F.array((F.col("id") % 3)).alias("list"), (F.col("id") % 2 == 0).alias("flag")).repartition(6)
    want = {"id": 3000, "almost": 2999, "code_a": 2700, "code_b": 2699, "eight": 8, "nine": 9, "f": 5, "list": 3, "flag": 2}
    assert {r.column_name: r.n_distinct for r in R.distinct_counts(df).collect()} == want
    counted = []
    exact = R.distinct_counts
    monkeypatch.setattr(R, "distinct_counts", lambda d, c=None: counted.append(c) or exact(d, c))
    assert {r.column_name for r in R.id_columns(df).collect()} == {"id", "code_a"}
    assert {r.column_name: r.n_distinct for r in R.low_cardinality_columns(df).collect()} == {"eight": 8, "list": 3, "flag": 2}
    assert counted[0] == ["id", "almost", "code_a", "code_b"] and "code_a" not in counted[1] and "code_b" not in counted[1]
    assert R.id_columns(df.limit(0)).collect() == []
