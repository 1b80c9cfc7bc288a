"""Order-dependent operators without a single-task window.

A window with no PARTITION BY (or one whose key holds a third of the rows)
runs in one task. The operators here instead range-partition the rows on the
full ordering key, work inside each partition, and repair the partition
boundaries with a small per-partition summary:

1. ``repartitionByRange(group, order)`` + ``sortWithinPartitions``; a hot
   group is spread over many partitions because the order column is part of
   the range key.
2. an Arrow ``mapInPandas`` pass computes the partition-local result
   (running sum, previous value) and tags rows with the partition id;
   the result is checkpointed so both later passes read the same rows.
3. ``groupBy(partition, group)`` gives at most partitions + groups rows;
   a window over that summary turns it into per-partition offsets, which
   are joined back.

Callers pre-aggregate duplicates of the ordering key (``groupBy(...).count()``)
so no single order value can overload a partition.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stable

_PID = "_pid"
_LOCAL = "_local"


def _same_key(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    eq = pd.Series(True, index=a.index)
    for c in a.columns:
        x, y = a[c], b[c]
        eq &= (x == y).fillna(False) | (x.isna() & y.isna())
    return eq


def _key_equals(row: tuple, key: tuple | None) -> bool:
    if key is None:
        return False
    for x, y in zip(row, key):
        if pd.isna(x) and pd.isna(y):
            continue
        if pd.isna(x) or pd.isna(y) or x != y:
            return False
    return True


def _ranged(df: DataFrame, group_cols: list[str], order_cols: list[str], parts: int | None) -> DataFrame:
    """Range partitions on the full ordering key. Without ``parts`` the count is left to AQE, which
    coalesces adjacent (still ordered) ranges to its advisory size, so partitions track data volume."""
    keys = [F.col(c) for c in group_cols + order_cols]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], small_right: bool = False) -> DataFrame:
    l, r = left.alias("_l"), (F.broadcast(right) if small_right else right).alias("_r")
    cond = reduce(lambda a, b: a & b, [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in cols])
    keep = [F.col(f"_l.{c}") for c in left.columns]
    extra = [F.col(f"_r.{c}") for c in right.columns if c not in cols]
    return l.join(r, cond, "inner").select(*keep, *extra)


def prefix_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], weights: list[str], outs: list[str],
                totals: list[str] | None = None, parts: int | None = None, few_groups: bool = False) -> DataFrame:
    """Exclusive running sums of several weight columns in ``order_cols`` order per group, one range sort for all.

    The ordering key (group + order columns) should be unique; pre-aggregate
    repeated keys and carry their multiplicity in a weight. With ``totals``
    every row also carries its group's total of each weight (taken from the
    per-partition summary, no extra pass over the rows). ``few_groups``
    declares the number of groups bounded (e.g. one per column): the offset
    table (partitions + groups rows) is then broadcast instead of shuffling
    the rows for the join.
    """
    integral = [isinstance(df.schema[w].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for w in weights]
    kinds = [T.LongType() if i else T.DoubleType() for i in integral]
    local_cols = [f"{_LOCAL}{k}" for k in range(len(weights))]
    schema = T.StructType(df.schema.fields + [T.StructField(_PID, T.IntegerType(), False)]
                          + [T.StructField(n, t, False) for n, t in zip(local_cols, kinds)])

    def local(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry_key, carry = None, [0] * len(weights)
        for pdf in batches:
            if pdf.empty:
                continue
            if group_cols:
                keys = pdf[group_cols].reset_index(drop=True)
                changed = ~_same_key(keys, keys.shift(1))
                continues = _key_equals(tuple(keys.iloc[0]), carry_key)
                changed.iloc[0] = not continues
                gid = changed.cumsum().to_numpy()
            else:
                continues = carry_key is not None
                gid = pd.Series(0, index=range(len(pdf))).to_numpy()
            added = {}
            for k, w in enumerate(weights):
                wv = pd.Series(pdf[w].fillna(0).astype("int64" if integral[k] else "float64").to_numpy())
                excl = wv.groupby(gid).cumsum() - wv
                if continues:
                    excl[gid == 0] += carry[k]
                carry[k] = wv[gid == gid[-1]].sum() + (carry[k] if (continues and gid[-1] == 0) else 0)
                added[local_cols[k]] = excl.to_numpy()
            carry_key = tuple(pdf[group_cols].iloc[-1]) if group_cols else ()
            yield pdf.assign(**{_PID: pid, **added})

    loc = stable(_ranged(df, group_cols, order_cols, parts).mapInPandas(local, schema))
    tot = loc.groupBy(_PID, *group_cols).agg(*[F.sum(w).alias(f"_ptot{k}") for k, w in enumerate(weights)])
    part = [F.col(c) for c in group_cols] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(f"_ptot{k}").over(Window.partitionBy(*part)).cast(kinds[k]).alias(t) for k, t in enumerate(totals or [])]
    offsets = [F.coalesce(F.sum(f"_ptot{k}").over(w), F.lit(0)).alias(f"_off{k}") for k in range(len(weights))]
    out = null_safe_join(loc, tot.select(_PID, *group_cols, *offsets, *extra), [_PID] + group_cols, small_right=few_groups or not group_cols)
    sums = [(F.col(local_cols[k]) + F.col(f"_off{k}")).cast(kinds[k]).alias(o) for k, o in enumerate(outs)]
    return out.select(*[c for c in df.columns if c not in outs], *(totals or []), *sums)


def prefix_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], weight_col: str,
               out_col: str = "cum_before", parts: int | None = None, total_col: str | None = None,
               few_groups: bool = False) -> DataFrame:
    """``prefix_sums`` of one weight."""
    return prefix_sums(df, group_cols, order_cols, [weight_col], [out_col], [total_col] if total_col else None, parts, few_groups)


def row_index(df: DataFrame, group_cols: list[str], order_cols: list[str],
              out_col: str = "idx", parts: int | None = None) -> DataFrame:
    """0-based position in ``order_cols`` order per group (order key must be unique)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return prefix_sum(one, group_cols, order_cols, "_one", out_col, parts).drop("_one")


def previous_value(df: DataFrame, group_cols: list[str], order_col: str,
                   out_col: str = "prev", parts: int | None = None) -> DataFrame:
    """Previous ``order_col`` value within the group (lag 1 over unique order values)."""
    otype = df.schema[order_col].dataType
    schema = T.StructType(df.schema.fields + [T.StructField(_PID, T.IntegerType(), False),
                                              T.StructField(_LOCAL, otype, True)])

    def local(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry_key, carry_val = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.reset_index(drop=True)
            prev = pdf[order_col].shift(1)
            if group_cols:
                keys = pdf[group_cols]
                changed = ~_same_key(keys, keys.shift(1))
                continues = _key_equals(tuple(keys.iloc[0]), carry_key)
            else:
                changed = pd.Series(False, index=pdf.index)
                continues = carry_key is not None
            changed.iloc[0] = True
            prev = prev.where(~changed, None)
            if continues:
                prev.iloc[0] = carry_val
            carry_key = tuple(pdf[group_cols].iloc[-1]) if group_cols else ()
            carry_val = pdf[order_col].iloc[-1]
            yield pdf.assign(**{_PID: pid, _LOCAL: prev})

    loc = stable(_ranged(df, group_cols, [order_col], parts).mapInPandas(local, schema))
    tot = loc.groupBy(_PID, *group_cols).agg(F.max(order_col).alias("_pmax"))
    part = [F.col(c) for c in group_cols] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(_PID, *group_cols, F.max("_pmax").over(w).alias("_before"))
    out = null_safe_join(loc, off, [_PID] + group_cols, small_right=not group_cols)
    return (out.withColumn(out_col, F.coalesce(F.col(_LOCAL), F.col("_before")))
            .drop(_PID, _LOCAL, "_before"))
