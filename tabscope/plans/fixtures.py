"""Derived inputs written identically in Spark and in the oracle SQL.

The driver tables hold no NULL and no duplicate row, so cleaning and
missing-value queries read frames derived from them (rules in FIXTURES.md).
Each builder has a matching SQL text in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    base = ev.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("mostly_null"))
    return base.unionByName(base.where(F.col("event_id") % 50 == 0))


def orders_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(~F.dayofmonth("o_orderdate").isin(5, 17))


def part_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag",
                     F.col("l_quantity").alias("quantity"),
                     F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unitprice"))


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the order date also as day-first text (datetime detection input)."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice",
                    F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_day"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_iso"))


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem numerics with values missing in three columns, in overlapping rows, and one column without any value."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 != 0, F.col("l_extendedprice")).alias("l_extendedprice"), "l_discount",
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"), F.lit(None).cast("double").alias("l_none"))


def lineitem_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem numerics with two mixtures of quantity and discount, correlated a little above and a little below 0.7."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("blend_above", F.col("l_quantity") + 440 * F.col("l_discount")).withColumn(
        "blend_below", F.col("l_quantity") + 500 * F.col("l_discount"))


SQL = {
    "lineitem_gaps": """
        (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
                CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_extendedprice END AS l_extendedprice, l_discount,
                CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, CAST(NULL AS DOUBLE) AS l_none FROM lineitem)""",
    "lineitem_blends": """
        (SELECT *, l_quantity + 440 * l_discount AS blend_above, l_quantity + 500 * l_discount AS blend_below FROM lineitem)""",
    "events_dirty": """
        (WITH b AS (
           SELECT event_id, ts, user_id,
                  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
                  CASE WHEN event_id % 7 <> 0 THEN value END AS value,
                  CASE WHEN event_id % 5 = 0 THEN user_id END AS mostly_null
           FROM events)
         SELECT * FROM b UNION ALL SELECT * FROM b WHERE event_id % 50 = 0)""",
    "orders_gappy": """
        (SELECT * FROM orders WHERE day(o_orderdate) NOT IN (5, 17))""",
    "part_sales": """
        (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_quantity AS quantity,
                CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unitprice
         FROM lineitem)""",
    "orders_text": """
        (SELECT o_orderkey, o_orderstatus, o_totalprice,
                strftime(o_orderdate, '%d/%m/%Y') AS order_day,
                strftime(o_orderdate, '%Y-%m-%d') AS order_iso
         FROM orders)""",
}
