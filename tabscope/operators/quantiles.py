"""Exact and approximate quantiles for many columns (and groups) at once.

Exact quantiles use linear interpolation between the order statistics at
``floor(p*(n-1))`` and ``ceil(p*(n-1))`` (pandas / DuckDB ``quantile_cont``).
Spark's own ``percentile`` keeps a value->count map per group and merges it
in one task for an ungrouped aggregate, which does not scale to a column with
billions of distinct values. Here the values are counted per (column, value)
with a partial aggregate, ranked with a distributed prefix sum, and the two
order statistics per probability are picked in one filter pass (every
ranked row knows its group size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import num, q
from .ordered import prefix_sum


def long_values(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, v DOUBLE) for non-missing numeric values."""
    keys = keys or []
    if not columns:
        raise ValueError("no numeric columns")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), num(df, c).alias("v")) for c in columns])
    return (df.select(*[F.col(q(k)) for k in keys], F.inline(pairs))
            .where(F.col("v").isNotNull()))


def value_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, v, cnt): partial-aggregated, so a hot value costs one row per task.

    One aggregate per column, unioned: each branch groups a single double
    (cheaper than grouping an unpivoted (name, value) pair) and reads only its
    own column from a columnar source.
    """
    keys = keys or []
    if not columns:
        raise ValueError("no numeric columns")
    parts = [df.select(*[F.col(q(k)) for k in keys], num(df, c).alias("v")).where(F.col("v").isNotNull())
             .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt"))
             .select(*keys, F.lit(c).alias("column_name"), "v", "cnt") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, v, cnt, before, n): value counts with their rank offset and group size."""
    keys = keys or []
    # without keys there is one group per column: a bounded offset table
    return prefix_sum(value_counts(df, columns, keys), keys + ["column_name"], ["v"], "cnt", "before",
                      total_col="n", few_groups=not keys)


def pick_quantiles(ranked: DataFrame, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, prob, value) from a ``ranked_counts`` table.

    Each ranked row (a distinct value with its rank offset ``before``, count
    ``cnt`` and group size ``n``) checks locally whether it holds the order
    statistic at floor/ceil(p * (n - 1)) — one filter pass, no join; only the
    matching rows (at most 2 per probability and group) reach the final aggregate.
    """
    keys = keys or []
    grp = keys + ["column_name"]
    if "n" not in ranked.columns:
        sizes = ranked.groupBy(*grp).agg(F.sum("cnt").alias("n"))
        ranked = ranked.join(sizes, grp)
    hits = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("cnt"))
        hits.append(F.struct(F.lit(float(p)).alias("prob"), (pos - F.floor(pos)).alias("frac"),
                             F.when(inside(lo), F.col("v")).alias("lo"), F.when(inside(hi), F.col("v")).alias("hi")))
    cand = ranked.select(*grp, F.inline(F.array(*hits))).where(F.col("lo").isNotNull() | F.col("hi").isNotNull())
    out = cand.groupBy(*grp, "prob").agg(F.max("lo").alias("_lo"), F.max("hi").alias("_hi"), F.max("frac").alias("_frac"))
    return out.select(*grp, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("value"))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] | None = None,
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Long table (keys..., column_name, prob, value); ``exact=False`` uses ``percentile_approx``."""
    keys = keys or []
    if not exact:
        lv = long_values(df, columns, keys)
        agg = lv.groupBy(*keys, "column_name").agg(
            F.percentile_approx("v", [float(p) for p in probs], accuracy).alias("_qs"))
        return agg.select(*keys, "column_name",
                          F.posexplode("_qs").alias("_i", "value")).withColumn(
            "prob", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
        ).drop("_i")
    return pick_quantiles(ranked_counts(df, columns, keys), probs, keys)
