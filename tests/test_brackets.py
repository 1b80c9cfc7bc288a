"""Order statistics by brackets against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import brackets as B
from tabscope.operators import clean


@pytest.fixture(scope="module")
def table(spark):
    """A uniform, a hot-valued, a three-valued, a constant, an all-missing and a gappy column with infinities."""
    rng = random.Random(3)
    rows = []
    for i in range(20_000):
        rows.append((rng.random(), 7.5 if i % 3 else rng.gauss(0, 1e6), float(i % 3), 4.0, None,
                     None if i % 5 == 0 else float("nan") if i % 5 == 1 else float("inf") if i == 2 else -float("inf") if i == 3 else rng.expovariate(1)))
    return spark.createDataFrame(rows, "u double, hot double, three double, same double, none double, gappy double").repartition(7).cache(), rows


def kept(rows, j):
    return sorted(r[j] for r in rows if r[j] is not None and not math.isnan(r[j]))


def test_order_statistics(table):
    df, rows = table
    sketch = B.Sketch(df, df.columns)
    assert sketch.rows == len(rows)
    ranks = {c: [0, 1, len(kept(rows, j)) // 3, len(kept(rows, j)) // 2, len(kept(rows, j)) - 1, len(rows) + 5] for j, c in enumerate(df.columns)}
    found, row = B.order_statistics(df, sketch, ranks, [("n", F.count("u"), 1)])
    assert row["n"] == len(rows)
    for j, c in enumerate(df.columns):
        values = kept(rows, j)
        assert sketch.count[c] == len(values)
        for r in ranks[c]:
            if not 0 <= r < len(values):
                assert (c, r) not in found
                continue
            held = found[c, r]
            assert (held.value, held.below, held.equal) == (values[r], sum(v < values[r] for v in values), values.count(values[r]))


def test_ranks_over_range_partitions_and_wrong_grids(table, monkeypatch):
    """Large brackets are ranked over range partitions; a grid that misleads costs work, not results."""
    df, rows = table
    monkeypatch.setattr(B, "IN_TASK", 10)
    sketch = B.Sketch(df, ["u", "hot"])
    values, below = sketch.grid["u"]
    sketch.grid["u"] = (values / 10, below)
    found, _ = B.order_statistics(df, sketch, {"u": [5000, 19_999], "hot": [3000]})
    assert found["u", 5000].value == kept(rows, 0)[5000] and found["u", 19_999].value == kept(rows, 0)[-1]
    assert found["hot", 3000].value == kept(rows, 1)[3000]


@pytest.mark.parametrize("values", [[1.0, None, 3.0, 10.0, None], [None, None], [5.0], [2.0, 2.0, None, 9.0], [1.0, 2.0, 3.0, 4.0, None, None, None, 50.0], list(range(9)) + [None] * 30])
def test_filled_quartiles_without_filling(spark, values):
    """Median and fences of the filled column equal those computed step by step."""
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    together, _ = clean.apply_cleaning(df, [clean.IMPUTE_MEDIAN, clean.WINSORIZE])
    apart = clean.winsorize(clean.impute_median(df))
    key = lambda r: (r.v is None, r.v or 0)
    assert sorted(together.collect(), key=key) == sorted(apart.collect(), key=key)
