"""Structured Streaming adapters: the dashboard aggregates kept current over a
growing input (a landing folder of files), with Spark's state store holding
the running partial aggregates.

The reference recomputes its dashboard over a whole file on every refresh;
on a stream the same KPI and bar aggregates are maintained incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import num, numeric_columns


def running_kpis(stream: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D1-D2 on a stream: one row (rows, sum_<c>, mean_<c>) for the first three numerics;
    use output mode ``complete`` (or ``update``)."""
    columns = columns if columns is not None else numeric_columns(stream)[:3]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.sum(num(stream, c)).alias(f"sum_{c}"), F.avg(num(stream, c)).alias(f"mean_{c}")]
    return stream.agg(*aggs)
