"""Registered queries: name -> Spark builder (spark, sf_dir) and name -> oracle SQL.

Every builder reads the driver tables (or frames Spark derives from them) in
full. Doubles are rounded in both the Spark result and the SQL text so the
two engines agree despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Column lists of the driver tables used by the SQL generators.
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLS = LINEITEM_NUM[:4] + ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENTS_NUM = ["event_id", "user_id", "value"]
DIRTY_COLS = ["event_id", "ts", "user_id", "event_type", "value", "mostly_null"]
DIRTY_NUM = ["event_id", "user_id", "value", "mostly_null"]
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (results compared across engines)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def T_(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fx.table(spark, sf, name)


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r6(e: str, d: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {d})"


def sig(c, digits: int = 9):
    """Round a DOUBLE column to ``digits`` significant digits (same formula as ``sig_sql``)."""
    m = (F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))).cast("int")
    up = F.round(c * F.pow(F.lit(10.0), m)) / F.pow(F.lit(10.0), m)
    down = F.round(c / F.pow(F.lit(10.0), -m)) * F.pow(F.lit(10.0), -m)
    return F.when((c == 0) | c.isNull() | F.isnan(c), c).when(m >= 0, up).otherwise(down)


def sig_sql(e: str, digits: int = 9) -> str:
    m = f"CAST({digits - 1} - floor(log10(abs({e}))) AS INTEGER)"
    return (f"CASE WHEN ({e}) = 0 OR ({e}) IS NULL OR isnan({e}) THEN ({e}) WHEN {m} >= 0 "
            f"THEN round(({e}) * power(10.0, {m})) / power(10.0, {m}) "
            f"ELSE round(({e}) / power(10.0, -{m})) * power(10.0, -{m}) END")
