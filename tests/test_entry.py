import importlib


def test_entry_and_registry(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0 and "p50" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80
    for name in ["numeric_summary", "top_values", "kpis"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0
