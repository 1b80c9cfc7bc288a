"""Registered source/sink queries (S1-S9): round trips of the driver tables through
delimited text and workbooks, load metadata and validation checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import roles as R
from ..session import ensure_checkpoint_dir
from ..sources import delimited, tables, workbook
from . import fixtures as fx
from .catalog import T_, register


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


@register("load_meta", "SELECT 'lineitem.parquet' AS file_name, '.parquet' AS suffix, CAST(count(*) AS BIGINT) AS rows, "
          "CAST(11 AS BIGINT) AS columns FROM lineitem")
def q_load_meta(spark, sf):
    return tables.load_meta(tables.read_table(spark, f"{sf}/lineitem.parquet"))


@register("table_checks", """
SELECT 'required' AS "check", 'o_orderkey' AS column_name, TRUE AS ok, CAST(0 AS BIGINT) AS n_bad
UNION ALL SELECT 'required', 'o_missing', FALSE, 1
UNION ALL SELECT 'not_empty', NULL, count(*) > 0, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT) FROM orders
UNION ALL SELECT 'not_null', 'o_orderkey', count(*) = count(o_orderkey), CAST(count(*) - count(o_orderkey) AS BIGINT) FROM orders
UNION ALL SELECT 'not_null', 'o_orderdate', count(*) = count(o_orderdate), CAST(count(*) - count(o_orderdate) AS BIGINT) FROM orders
UNION ALL SELECT 'unique', 'o_orderkey', sum(k - 1) FILTER (WHERE k > 1) IS NULL, CAST(coalesce(sum(k - 1) FILTER (WHERE k > 1), 0) AS BIGINT)
  FROM (SELECT o_orderkey, count(*) AS k FROM orders GROUP BY 1)
UNION ALL SELECT 'unique', 'o_custkey', sum(k - 1) FILTER (WHERE k > 1) IS NULL, CAST(coalesce(sum(k - 1) FILTER (WHERE k > 1), 0) AS BIGINT)
  FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1)""")
def q_table_checks(spark, sf):
    return tables.checks(T_(spark, sf, "orders"), required=["o_orderkey", "o_missing"],
                         not_null=["o_orderkey", "o_orderdate"], unique=["o_orderkey", "o_custkey"])


@register("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, "
          "o_orderdate, o_orderpriority FROM orders")
def q_csv_roundtrip(spark, sf):
    """Orders written as ';'-separated text, then encoding/delimiter detected and read back."""
    path = _scratch(spark, "orders-csv")
    T_(spark, sf, "orders").write.mode("overwrite").option("header", "true").option("sep", ";").csv(path)
    back = delimited.read_delimited(spark, path)
    return back.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
                       F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"),
                       F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


@register("csv_quoted", "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents")
def q_csv_quoted(spark, sf):
    """Whole documents, with line breaks, quotes and delimiters inside, written as quoted text and read back by pieces."""
    path = _scratch(spark, "documents-csv")
    T_(spark, sf, "documents").write.option("header", "true").option("sep", ";").option("escape", '"').csv(path)
    back = delimited.read_delimited(spark, path)
    return back.select(F.col("doc_id").cast("long"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", F.col("n_chars").cast("long"))


@register("csv_detect", "SELECT 'UTF-8' AS encoding, ';' AS delimiter, CAST(count(*) AS BIGINT) AS rows, "
          "CAST(6 AS BIGINT) AS columns FROM orders")
def q_csv_detect(spark, sf):
    path = _scratch(spark, "orders-csv")
    T_(spark, sf, "orders").write.mode("overwrite").option("header", "true").option("sep", ";").csv(path)
    meta = delimited.delimited_meta(spark, path)
    return meta.groupBy("encoding", "delimiter").agg(F.sum("rows").cast("long").alias("rows"),
                                                     F.max("columns").alias("columns"))


@register("workbook_roundtrip", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment "
          "FROM customer")
def q_workbook_roundtrip(spark, sf):
    """Customers written as workbooks (one per partition, sheet 'data') and read back."""
    path = _scratch(spark, "customer-xlsx")
    workbook.write_workbooks(T_(spark, sf, "customer"), path)
    back = tables.read_table(spark, path, fmt="xlsx")
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                       F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "c_mktsegment")


@register("workbook_headers", "SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal, 'a' AS book FROM customer "
          "UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2), 'b' FROM customer")
def q_workbook_headers(spark, sf):
    """Workbooks of two headers, with columns in another order and one more, united by name."""
    path = _scratch(spark, "mixed-xlsx")
    customer = T_(spark, sf, "customer")
    workbook.write_workbooks(customer.select("c_custkey", "c_name", F.lit("a").alias("book")), path)
    workbook.write_workbooks(customer.select(F.lit("b").alias("book"), "c_name", "c_acctbal", "c_custkey"), path)
    back = tables.read_table(spark, path, fmt="xlsx")
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "book")


@register("workbook_meta", "SELECT '.xlsx' AS suffix, 'data' AS sheets, 'data' AS selected_sheet, CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns FROM customer")
def q_workbook_meta(spark, sf):
    path = _scratch(spark, "customer-xlsx")
    workbook.write_workbooks(T_(spark, sf, "customer"), path)
    meta = workbook.workbook_meta(spark, path)
    return meta.groupBy("suffix", F.array_join("sheets", ",").alias("sheets"), "selected_sheet").agg(
        F.sum("rows").cast("long").alias("rows"), F.max("columns").cast("long").alias("columns"))


@register("datetime_coercion", "SELECT o_orderkey, CAST(strptime(order_day, '%d/%m/%Y') AS TIMESTAMP) AS order_day FROM "
          + fx.SQL["orders_text"] + " t")
def q_datetime_coercion(spark, sf):
    df = fx.orders_text(spark, sf)
    fmts = {r["column_name"]: r["format"] for r in R.datetime_columns(df).where("source = 'text'").collect()}
    return R.coerce_datetimes(df, fmts).select("o_orderkey", F.col("order_day").cast("timestamp_ntz").alias("order_day"))
