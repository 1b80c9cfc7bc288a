from tabscope.operators import clean as C


def fixture_b(spark):
    return spark.createDataFrame([(1.0, "x"), (1.0, "x"), (None, "y"), (4.0, None)], "a double, b string")


def test_plan_signals_and_no_change_without_approval(spark):
    df = fixture_b(spark)
    v = C.validation(df).first()
    assert v["missing_total"] == 2 and v["duplicate_rows"] == 1
    ids = [r["id"] for r in C.plan(df).orderBy("ord").collect()]
    assert ids == [C.DROP_HIGH_MISSING, C.IMPUTE_MEDIAN, C.IMPUTE_MODE, C.DROP_DUPLICATES, C.WINSORIZE,
                   C.SCALE, C.ONEHOT, C.DATETIME_PARTS]
    impact = C.plan(df).where(f"id = '{C.DROP_HIGH_MISSING}'").first()["impact"]
    assert impact == ""  # 25 % missing is below 60 %
    out, applied = C.apply_cleaning(df, apply=False)
    assert applied == [] and out.collect() == df.collect()
    out, applied = C.apply_cleaning(df, operations=None)
    assert applied == []


def test_fixed_order_and_steps(spark):
    df = fixture_b(spark)
    out, applied = C.apply_cleaning(df, ["winsorize_outliers", "unknown", "impute_categorical_mode",
                                         "impute_numeric_median", "drop_duplicates"])
    assert applied == [C.DROP_DUPLICATES, C.IMPUTE_MEDIAN, C.IMPUTE_MODE, C.WINSORIZE]
    rows = sorted((r["a"], r["b"]) for r in out.collect())
    # after dedup: a = [1, NULL, 4] -> median 2.5; b = [x, y, NULL] -> mode x (tie -> smallest)
    assert rows == [(1.0, "x"), (2.5, "y"), (4.0, "x")]


def test_drop_high_missing_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert C.drop_high_missing(df).columns == ["a"]
    empty = spark.createDataFrame([], "a int, b int")
    assert C.drop_high_missing(empty).columns == ["a", "b"]


def test_winsorize_keeps_nulls_and_clips(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (100,), (None,)], "v int")
    vals = sorted((r["v"] for r in C.winsorize(df).collect()), key=lambda x: (x is None, x))
    assert vals[:4] == [1.0, 2.0, 3.0, 4.0] and vals[4] == 7.0 and vals[5] is None


def test_onehot_and_datetime_parts(spark):
    import datetime as dt

    df = spark.createDataFrame([("a", dt.datetime(2024, 2, 29, 10)), ("b", dt.datetime(2024, 12, 31))], "s string, t timestamp")
    oh = C.onehot(df)
    assert set(oh.columns) >= {"s_a", "s_b"}
    parts = C.datetime_parts(df).orderBy("t").first()
    assert (parts["t_year"], parts["t_month"], parts["t_day"]) == (2024, 2, 29)


def test_wide_rows_are_told_apart_whole(spark, monkeypatch):
    """Repeats, swapped and missing values, NaN, arrays; digests that collide on purpose change no result."""
    from collections import Counter

    from pyspark.sql import functions as F

    from tabscope.operators import clean, profile

    rows = [("a", None, 1.0, [1]), (None, "a", 1.0, [1]), ("a", None, 1.0, [1]), ("x" * 500, "b", float("nan"), [1, 2]),
            ("x" * 500, "b", float("nan"), [1, 2]), ("x" * 500, "b", None, [1, 2]), (None, None, None, None), (None, None, None, None)] + [("hot", "hot", 2.0, [3])] * 300
    df = spark.createDataFrame(rows, "p string, q string, r double, l array<int>").repartition(4)
    distinct = Counter(map(str, df.distinct().collect()))
    folded = len({(p, q, None if r is None or r != r else r, None if l is None else tuple(l)) for p, q, r, l in rows})

    def check():
        got = profile.duplicate_rows(df).first()
        assert (got["n_rows"], got["distinct_rows"], got["duplicate_rows"]) == (len(rows), folded, len(rows) - folded)
        assert Counter(map(str, clean.drop_duplicates(df).collect())) == distinct

    check()
    same = lambda d: [F.lit(1).alias("_h1"), F.lit(2).alias("_h2")]
    monkeypatch.setattr(profile, "row_digest", same)
    monkeypatch.setattr(clean, "row_digest", same)
    check()
    empty = df.limit(0)
    assert profile.duplicate_rows(empty).first()["n_rows"] == 0 and clean.drop_duplicates(empty).count() == 0
