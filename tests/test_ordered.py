import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabscope.operators.ordered import prefix_sum, previous_value, row_index


def test_prefix_sum_matches_cumsum_with_hot_group(spark):
    rng = np.random.default_rng(1)
    # one key holds most rows, so it spans several range partitions
    keys = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b", "c"], 3000))
    pdf = pd.DataFrame({"k": keys, "v": np.arange(3000, dtype=float), "w": rng.integers(1, 5, 3000)})
    out = prefix_sum(spark.createDataFrame(pdf), ["k"], ["v"], "w", parts=7).toPandas()
    pdf = pdf.sort_values(["k", "v"])
    pdf["exp"] = pdf.groupby("k")["w"].cumsum() - pdf["w"]
    got = out.set_index(["k", "v"])["cum_before"]
    exp = pdf.set_index(["k", "v"])["exp"]
    assert (got.loc[exp.index].to_numpy() == exp.to_numpy()).all()


def test_row_index_without_groups(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    out = row_index(df, [], ["x"], parts=5).toPandas().sort_values("x")
    assert out["idx"].tolist() == list(range(500))


def test_previous_value(spark):
    pdf = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 3, "t": [1, 3, 4, 9, 10, 2, 5, 6]})
    out = previous_value(spark.createDataFrame(pdf), ["k"], "t", parts=3).toPandas().sort_values(["k", "t"])
    assert out["prev"].fillna(-1).astype(int).tolist() == [-1, 1, 3, 4, 9, -1, 2, 5]


def test_prefix_sum_with_adaptive_partition_count(spark):
    pdf = pd.DataFrame({"k": ["x"] * 400 + ["y"] * 100, "v": np.arange(500, dtype=float), "w": 1})
    out = prefix_sum(spark.createDataFrame(pdf).repartition(6), ["k"], ["v"], "w").toPandas()
    got = out.sort_values(["k", "v"])["cum_before"].tolist()
    assert got == list(range(400)) + list(range(100))
