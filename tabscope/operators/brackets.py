"""Exact order statistics of many columns in three scans, without sorting the columns.

1. A quantile sketch of every column (one aggregate, merged in ``GROUPS`` groups so that no task merges the sketches of
   all partitions) gives an approximate quantile grid per column, with row counts and means.
2. Every wanted rank gets a bracket from the grid. One aggregate counts exactly how many values lie below and up to the
   ends of each bracket; a bracket that turns out not to hold its rank is widened to the whole column.
3. Only values inside brackets, about one in a hundred, are counted by value and put in order.

The grid therefore decides how much work the third scan does and never what the result is. A bracket whose ends are the
same value needs no third scan. Per column a fixed number of numbers comes to the driver, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import one_row_agg
from ..functions.columns import num
from .ordered import prefix_sum

GRID = 400
ACCURACY = 4000  # of percentile_approx: ranks are off by at most rows / ACCURACY
GROUPS = 32
CHUNK = 16  # columns sketched by one aggregate
IN_TASK = 1 << 22  # values of one bracket that a task sorts; beyond, they are ranked over range partitions


class Sketch:
    """Row count and, by column, the number of non-missing values, their mean and an approximate quantile grid."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns, self.rows = columns, 0
        self.count, self.mean, self.grid = {}, {}, {}
        levels = "array(" + ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1)) + ")"
        for at in range(0, len(columns), CHUNK):
            part = columns[at:at + CHUNK]
            values = df.select((F.spark_partition_id() % GROUPS).alias("g"), *[num(df, c).alias(f"v{i}") for i, c in enumerate(part)])
            stats = [F.expr(e) for i in range(len(part)) for e in
                     (f"count(v{i}) AS n{i}", f"avg(v{i}) AS m{i}", f"percentile_approx(v{i}, {levels}, {ACCURACY}) AS q{i}")]
            groups = values.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), *stats).collect()  # at most GROUPS rows
            self.rows = sum(r["rows"] for r in groups)
            for i, c in enumerate(part):
                held = [(r[f"n{i}"], r[f"m{i}"], r[f"q{i}"]) for r in groups if r[f"n{i}"]]
                self.count[c] = sum(n for n, _, _ in held)
                with np.errstate(all="ignore"):
                    self.mean[c] = float(sum(m * (n / self.count[c]) for n, m, _ in held)) if held else 0.0
                self.grid[c] = _merged([(n, g) for n, _, g in held])

    def bracket(self, column: str, rank: int) -> tuple[float | None, float | None]:
        """Values between which the rank should lie; None leaves an end open."""
        n, (values, below) = self.count[column], self.grid[column]
        slack = n * (1 / GRID + 2 / ACCURACY) + 2
        lo = int(np.searchsorted(below, rank - slack, side="right")) - 1
        hi = int(np.searchsorted(below, rank + slack, side="left"))
        return (float(values[lo]) if lo >= 0 else None), (float(values[hi]) if hi < len(values) else None)


def _merged(grids: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Grid values of all groups in order and about how many of all values lie below each."""
    if not grids:
        return np.zeros(0), np.zeros(0)
    values = np.concatenate([np.asarray(g, float) for _, g in grids])
    weights = np.concatenate([np.full(len(g), n / len(g)) for n, g in grids])
    order = np.argsort(values, kind="stable")
    return values[order], np.cumsum(weights[order]) - weights[order] / 2


class Held:
    """A value of the data with the number of values below it and equal to it."""

    def __init__(self, value: float, below: int, equal: int):
        self.value, self.below, self.equal = value, below, equal


def order_statistics(df: DataFrame, sketch: Sketch, ranks: dict[str, list[int]],
                     more: list[tuple] = ()) -> tuple[dict[tuple[str, int], Held], dict]:
    """The values at 0-based ranks of the sorted non-missing values of each column, and the values of ``more``.

    more: (alias, expression, buffer slots) aggregates that the second scan computes on the way. Infinities are values;
    NaN and NULL are missing; a rank outside a column's values gives no entry.
    """
    wanted = [(c, r) for c, rs in ranks.items() for r in sorted(set(rs)) if 0 <= r < sketch.count[c]]
    brackets = {w: sketch.bracket(*w) for w in wanted}
    ends = sorted({(c, side, end) for (c, _), b in brackets.items() for side, end in zip(("<", "<="), b) if end is not None})
    specs = [(f"e{i}", F.count(F.when(num(df, c) < F.lit(end) if side == "<" else num(df, c) <= F.lit(end), 1)), 1) for i, (c, side, end) in enumerate(ends)]
    row = one_row_agg(df, [*specs, *more]).first().asDict() if specs or more else {}
    upto = {end: row[f"e{i}"] for i, end in enumerate(ends)}

    found: dict[tuple[str, int], Held] = {}
    open_: dict[tuple, list[int]] = {}
    for (c, r), (lo, hi) in brackets.items():
        before, after = upto.get((c, "<", lo), 0), upto.get((c, "<=", hi), sketch.count[c])
        if not before <= r < after:
            lo, hi, before, after = None, None, 0, sketch.count[c]
        if lo is not None and lo == hi:
            found[c, r] = Held(lo, before, after - before)
        else:
            open_.setdefault((c, lo, hi, before, after), []).append(r)
    for (c, r), held in _inside(df, open_):
        found[c, r] = held
    return found, row


def _inside(df: DataFrame, brackets: dict[tuple, list[int]]):
    """((column, rank), Held) of the ranks in brackets (column, lo, hi, values below, values up to hi)."""
    if not brackets:
        return
    keys = list(brackets)

    cells = []
    for k, (c, lo, hi, *_) in enumerate(keys):
        v = num(df, c)
        within = v.isNotNull()
        if lo is not None:
            within = within & (v >= F.lit(lo))
        if hi is not None:
            within = within & (v <= F.lit(hi))
        cells.append(F.when(within, F.struct(F.lit(k).alias("k"), v.alias("v"))))
    values = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    if max(after - before for *_, before, after in keys) <= IN_TASK:
        w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        placed = values.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    else:
        placed = prefix_sum(values, ["k"], ["v"], "cnt", "before", few_groups=True)
    hits = [(F.col("k") == k) & (F.col("before") <= r - key[3]) & (F.col("before") + F.col("cnt") > r - key[3])
            for k, key in enumerate(keys) for r in brackets[key]]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    for row in placed.where(any_hit).collect():  # one row a rank at most
        key = keys[row["k"]]
        for r in brackets[key]:
            if row["before"] <= r - key[3] < row["before"] + row["cnt"]:
                yield (key[0], r), Held(row["v"], key[3] + row["before"], row["cnt"])


def quantile_ranks(n: int, probs: list[float]) -> list[int]:
    """Ranks that linear interpolation at the probabilities needs among n values."""
    return sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) if n else []


def interpolate(value_at: Callable[[int], float], n: int, prob: float) -> float | None:
    """Quantile of n values by linear interpolation between neighbouring ranks."""
    if not n:
        return None
    at = prob * (n - 1)
    lo, hi = value_at(math.floor(at)), value_at(math.ceil(at))
    return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], sketch: Sketch | None = None,
                     more: Callable[[Sketch], list[tuple]] = lambda s: []) -> tuple[dict[str, list[float | None]], Sketch, dict]:
    """Exact quantiles of each column (None without values), the sketch, and the aggregates of ``more`` of the second scan."""
    sketch = sketch or Sketch(df, columns)
    found, row = order_statistics(df, sketch, {c: quantile_ranks(sketch.count[c], probs) for c in columns}, more(sketch))
    return {c: [interpolate(lambda r, c=c: found[c, r].value, sketch.count[c], p) for p in probs] for c in columns}, sketch, row
