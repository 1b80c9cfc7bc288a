"""Registered profile and role queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import roles as R
from . import fixtures as fx
from .catalog import (DIRTY_COLS, EVENTS_NUM, LINEITEM_COLS, LINEITEM_NUM, T_, r6, register, rounded,
                      union_all)

D = fx.SQL["events_dirty"]
PS = fx.SQL["part_sales"]
OT = fx.SQL["orders_text"]


def _missing_sum(cols):
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


@register("profile_overview", f"""
WITH d AS {D}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(DIRTY_COLS)} AS BIGINT) AS n_columns,
       CAST(sum({_missing_sum(DIRTY_COLS)}) AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicate_rows
FROM d""")
def q_profile_overview(spark, sf):
    return P.overview(fx.events_dirty(spark, sf))


@register("missing_by_column", "WITH d AS " + D + "\n" + union_all([
    f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) / greatest(count(*), 1) * 100, 2) AS pct_missing FROM d"
    for i, c in enumerate(DIRTY_COLS)]))
def q_missing_by_column(spark, sf):
    return P.missing(fx.events_dirty(spark, sf))


@register("duplicate_rows", f"""
WITH d AS {D}
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS distinct_rows,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicate_rows
FROM d""")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(fx.events_dirty(spark, sf))


def _summary_sql(table: str, cols: list[str], all_cols: list[str], extra: bool = False) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        sel = (f"SELECT '{c}' AS column_name, CAST({all_cols.index(c)} AS INTEGER) AS ordinal, "
               f"CAST(count({x}) AS BIGINT) AS count, {r6(f'avg({x})')} AS mean, "
               f"{r6(f'stddev_samp({x})')} AS std, {r6(f'min({x})')} AS min, "
               f"{r6(f'quantile_cont({x}, 0.25)')} AS p25, {r6(f'quantile_cont({x}, 0.5)')} AS p50, "
               f"{r6(f'quantile_cont({x}, 0.75)')} AS p75, {r6(f'max({x})')} AS max")
        if extra:
            sel += (f", {r6(f'CASE WHEN var_pop({x}) = 0 AND count({x}) >= 3 THEN 0 ELSE skewness({x}) END')} AS skew"
                    f", {r6(f'CASE WHEN var_pop({x}) = 0 AND count({x}) >= 4 THEN 0 ELSE kurtosis({x}) END')} AS kurtosis")
        parts.append(sel + f" FROM {table}")
    return union_all(parts)


@register("numeric_summary", _summary_sql("lineitem", LINEITEM_NUM, LINEITEM_COLS))
def q_numeric_summary(spark, sf):
    return rounded(P.numeric_summary(T_(spark, sf, "lineitem")))


@register("numeric_summary_by_key", "WITH l AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, "
          "CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem)\n" + union_all([
              f"SELECT l_returnflag, '{name}' AS column_name, CAST(count({x}) AS BIGINT) AS count, "
              f"{r6(f'avg({x})')} AS mean, {r6(f'stddev_samp({x})')} AS std, {r6(f'min({x})')} AS min, "
              f"{r6(f'quantile_cont({x}, 0.25)')} AS p25, {r6(f'quantile_cont({x}, 0.5)')} AS p50, "
              f"{r6(f'quantile_cont({x}, 0.75)')} AS p75, {r6(f'max({x})')} AS max FROM l GROUP BY l_returnflag"
              for name, x in [("l_quantity", "q"), ("l_extendedprice", "p")]]))
def q_numeric_summary_by_key(spark, sf):
    li = T_(spark, sf, "lineitem")
    out = P.profile_by(li, ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return rounded(out.select("l_returnflag", "column_name", "count", "mean", "std", "min", "p25", "p50",
                              "p75", "max"))


def _long_text_sql(table: str, cols: list[str]) -> str:
    return union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols])


ORDERS_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@register("top_values", f"""
WITH long AS ({_long_text_sql('orders', ORDERS_CAT)}),
f AS (SELECT column_name, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY column_name, value)
SELECT column_name, rank, value, count FROM (
  SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS BIGINT) AS rank,
         value, CAST(count AS BIGINT) AS count FROM f) WHERE rank <= 10""")
def q_top_values(spark, sf):
    out = P.top_values(T_(spark, sf, "orders"))
    return out.withColumn("rank", F.col("rank").cast("long"))


CUSTOMER_CAT = ["c_name", "c_mktsegment"]


@register("categorical_summary", f"""
WITH long AS ({_long_text_sql('customer', CUSTOMER_CAT)}),
f AS (SELECT column_name, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY column_name, value),
d AS (SELECT column_name, CAST(count(*) AS BIGINT) AS n_distinct FROM f GROUP BY column_name)
SELECT t.column_name, d.n_distinct, t.rank, t.value, t.count FROM (
  SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS BIGINT) AS rank,
         value, CAST(count AS BIGINT) AS count FROM f) t JOIN d USING (column_name) WHERE t.rank <= 10""")
def q_categorical_summary(spark, sf):
    out = P.categorical_summary(T_(spark, sf, "customer"))
    return out.withColumn("rank", F.col("rank").cast("long"))


def _outlier_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 "
            f"FROM {table} HAVING count({x}) > 0")
    bounds = union_all(parts)
    counts = union_all([f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM {table}" for c in cols])
    return f"""
WITH b AS ({bounds}),
b2 AS (SELECT column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b),
v AS ({counts})
SELECT b2.column_name, {r6('b2.q1')} AS q1, {r6('b2.q3')} AS q3, {r6('b2.lower')} AS lower, {r6('b2.upper')} AS upper,
       CAST(count(CASE WHEN v.v < b2.lower OR v.v > b2.upper THEN 1 END) AS BIGINT) AS n_outliers
FROM b2 JOIN v USING (column_name) GROUP BY ALL"""


@register("iqr_outliers", _outlier_sql("events", EVENTS_NUM))
def q_iqr_outliers(spark, sf):
    return rounded(P.outliers(T_(spark, sf, "events")))


def _pair_sql(table: str, cols: list[str], kind: str, digits: int | None = 4) -> str:
    parts = []
    rnd = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            x = f"CASE WHEN {xa} IS NOT NULL AND {xb} IS NOT NULL THEN {xa} END"
            y = f"CASE WHEN {xa} IS NOT NULL AND {xb} IS NOT NULL THEN {xb} END"
            if kind == "corr":
                if i == j:
                    val = f"CASE WHEN min({xa}) < max({xa}) THEN 1.0 END"
                    n = f"count({xa})"
                else:
                    val = (f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN "
                           f"greatest(-1.0, least(1.0, covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})))) END")
                    n = f"count({y})"
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, {rnd(val)} AS r, "
                             f"CAST({n} AS BIGINT) AS n FROM {table}")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, "
                             f"{rnd(f'covar_samp({xa}, {xb})')} AS cov, CAST(count({y}) AS BIGINT) AS n FROM {table}")
    return union_all(parts)


@register("pearson_matrix", f"SELECT a, b, r, n FROM ({_pair_sql('lineitem', LINEITEM_NUM, 'corr')})")
def q_pearson_matrix(spark, sf):
    return P.pearson(T_(spark, sf, "lineitem"), digits=4).select("a", "b", "r", "n")


SALES_PAIR_COLS = ["quantity", "unitprice", "_computed_revenue", "l_linenumber"]
PS_REV = ("(SELECT *, TRY_CAST(quantity AS DOUBLE) * TRY_CAST(unitprice AS DOUBLE) AS _computed_revenue FROM "
          + PS + " p0)")


@register("strong_pairs", f"""
WITH ps AS {PS_REV}, m AS ({_pair_sql('ps', SALES_PAIR_COLS, 'corr', None)})
SELECT a, b, round(r, 4) AS r FROM m WHERE i < j AND abs(r) >= 0.0 ORDER BY abs(r) DESC, i, j LIMIT 20""")
def q_strong_pairs(spark, sf):
    sales, _ = R.with_revenue(fx.part_sales(spark, sf))
    out = P.strong_pairs(sales, SALES_PAIR_COLS, threshold=0.0)
    return out.withColumn("r", F.round("r", 4))


@register("data_volume", union_all(
    [f"SELECT '{c}' AS column_name, CAST(count(*) * {w} AS BIGINT) AS bytes, "
     f"round(count(*) * {w} / (1024.0 * 1024.0), 3) AS mb FROM orders"
     for c, w in [("o_orderkey", 8), ("o_custkey", 8)]]
    + [f"SELECT '{c}' AS column_name, CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS bytes, "
       f"round(coalesce(sum(strlen({c})), 0) / (1024.0 * 1024.0), 3) AS mb FROM orders"
       for c in ["o_orderstatus"]]
    + ["SELECT 'o_totalprice' AS column_name, CAST(count(*) * 8 AS BIGINT) AS bytes, "
       "round(count(*) * 8 / (1024.0 * 1024.0), 3) AS mb FROM orders",
       "SELECT 'o_orderdate' AS column_name, CAST(count(*) * 8 AS BIGINT) AS bytes, "
       "round(count(*) * 8 / (1024.0 * 1024.0), 3) AS mb FROM orders",
       "SELECT 'o_orderpriority' AS column_name, CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) AS bytes, "
       "round(coalesce(sum(strlen(o_orderpriority)), 0) / (1024.0 * 1024.0), 3) AS mb FROM orders"]))
def q_data_volume(spark, sf):
    return P.data_volume(T_(spark, sf, "orders"))


def _roles_sql(table: str, cols: list[tuple[str, bool, bool]], target: dict[str, int]) -> str:
    """cols: (name, is_integer, id_name)."""
    parts = []
    for i, (c, is_int, id_name) in enumerate(cols):
        rank = target.get(c)
        parts.append(
            f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, "
            f"CAST((SELECT count(*) FROM {table}) AS BIGINT) AS n_rows, "
            f"CAST(count(DISTINCT CAST({c} AS VARCHAR)) AS BIGINT) AS n_distinct, "
            f"{'TRUE' if is_int else 'FALSE'} AS is_integer, {'TRUE' if id_name else 'FALSE'} AS id_name, "
            f"CAST({rank if rank else 'NULL'} AS INTEGER) AS target_rank FROM {table}")
    return f"""
WITH s AS ({union_all(parts)})
SELECT column_name, ordinal, n_rows, n_distinct,
       round(CAST(n_distinct AS DOUBLE) / greatest(n_rows, 1), 6) AS distinct_ratio,
       (n_rows > 0 AND ((id_name AND CAST(n_distinct AS DOUBLE) / greatest(n_rows, 1) >= 0.9)
                        OR (is_integer AND CAST(n_distinct AS DOUBLE) / greatest(n_rows, 1) = 1.0))) AS is_id,
       target_rank
FROM s"""


PART_ROLE_COLS = [("p_partkey", True, True), ("p_name", False, False), ("p_brand", False, False),
                  ("p_type", False, False), ("p_size", True, False), ("p_retailprice", False, False)]
# target rule on part: keyword names first (p_retailprice has "price", p_type has "y"), then numerics
PART_TARGETS = {"p_partkey": 1, "p_type": 2, "p_retailprice": 3, "p_size": 4}


@register("column_roles", _roles_sql("part", PART_ROLE_COLS, PART_TARGETS))
def q_column_roles(spark, sf):
    out = R.roles(T_(spark, sf, "part"))
    return rounded(out.select("column_name", "ordinal", "n_rows", "n_distinct", "distinct_ratio", "is_id",
                              "target_rank"))


@register("id_columns", f"""
WITH r AS ({_roles_sql('part', PART_ROLE_COLS, PART_TARGETS)})
SELECT column_name, ordinal, n_distinct, distinct_ratio FROM r WHERE is_id""")
def q_id_columns(spark, sf):
    return rounded(R.id_columns(T_(spark, sf, "part")))


def _target_sql(table: str) -> str:
    kw = " OR ".join(f"contains(lower(column_name), '{k}')" for k in R.TARGET_KEYWORDS)
    numeric = ("data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','FLOAT','DOUBLE','REAL','HUGEINT') "
               "OR data_type LIKE 'DECIMAL%'")
    return f"""
WITH c AS (SELECT column_name, ordinal_position AS pos, ({kw}) AS kw, ({numeric}) AS isnum
           FROM information_schema.columns WHERE table_name = '{table}'),
o AS (SELECT column_name, CASE WHEN kw THEN 0 ELSE 1 END AS grp, pos FROM c WHERE kw OR isnum)
SELECT column_name, CAST(target_rank AS INTEGER) AS target_rank FROM (
  SELECT column_name, row_number() OVER (ORDER BY grp, pos) AS target_rank FROM o) WHERE target_rank <= 10"""


@register("target_candidates", _target_sql("lineitem"))
def q_target_candidates(spark, sf):
    return R.target_candidates(T_(spark, sf, "lineitem"))


@register("revenue_column", f"""
SELECT l_orderkey, l_linenumber, round(CAST(TRY_CAST(quantity AS DOUBLE) * TRY_CAST(unitprice AS DOUBLE) AS DOUBLE), 4)
       AS _computed_revenue FROM {PS} ps""")
def q_revenue_column(spark, sf):
    df, name = R.with_revenue(fx.part_sales(spark, sf))
    return df.select("l_orderkey", "l_linenumber", F.round(name, 4).alias("_computed_revenue"))


@register("numeric_projection", "SELECT " + ", ".join(LINEITEM_NUM) + " FROM lineitem")
def q_numeric_projection(spark, sf):
    return R.numeric_projection(T_(spark, sf, "lineitem"))


@register("low_cardinality", f"""
WITH long AS ({_long_text_sql('orders', ORDERS_CAT)})
SELECT column_name, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct,
       CAST(CASE column_name WHEN 'o_orderstatus' THEN 2 WHEN 'o_orderdate' THEN 4 ELSE 5 END AS INTEGER) AS ordinal
FROM long WHERE value IS NOT NULL GROUP BY column_name HAVING count(DISTINCT value) <= 8""")
def q_low_cardinality(spark, sf):
    return R.low_cardinality_columns(T_(spark, sf, "orders")).select("column_name", "n_distinct", "ordinal")


def _spark_to_strptime(fmt: str) -> str:
    out = fmt.replace("'T'", "T")
    for a, b in [("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")]:
        out = out.replace(a, b)
    return out


def _datetime_sql(table_sql: str, text_cols: list[tuple[str, int]]) -> str:
    parts = []
    for c, ordinal in text_cols:
        for k, fmt in enumerate(R.DATE_FORMATS):
            parts.append(
                f"SELECT '{c}' AS column_name, {ordinal} AS ordinal, '{fmt.replace("'", "''")}' AS format, {k} AS k, "
                f"count(CASE WHEN {c} IS NOT NULL AND try_strptime({c}, '{_spark_to_strptime(fmt)}') IS NOT NULL "
                f"THEN 1 END) / count({c}) AS share FROM t")
    return f"""
WITH t AS {table_sql}, s AS ({union_all(parts)})
SELECT column_name, CAST(ordinal AS INTEGER) AS ordinal, 'text' AS source, format FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY share DESC, k) AS best
  FROM s WHERE share >= 0.8) WHERE best = 1"""


@register("datetime_columns", _datetime_sql(OT, [("o_orderstatus", 1), ("order_day", 3), ("order_iso", 4)]))
def q_datetime_columns(spark, sf):
    return R.datetime_columns(fx.orders_text(spark, sf))


@register("column_types", """
SELECT column_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date'
       WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(data_type) END AS dtype,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type IN ('TIMESTAMP', 'DATE') THEN 'datetime'
       WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'other' END AS kind
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def q_column_types(spark, sf):
    return P.column_types(T_(spark, sf, "lineitem"))


VALUE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _value_column_sql() -> str:
    kw = " OR ".join(f"contains(lower(trim(column_name)), '{k}')" for k in R.VALUE_KEYWORDS)
    idlike = ("lower(trim(column_name)) IN ('id', 'index') OR ends_with(lower(trim(column_name)), '_id') "
              "OR ends_with(lower(trim(column_name)), 'id')")
    tables = ", ".join(f"'{t}'" for t in VALUE_TABLES)
    return f"""
WITH c AS (SELECT table_name, column_name, ordinal_position AS pos,
                  data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','FLOAT','DOUBLE','REAL') OR data_type LIKE 'DECIMAL%' AS isnum,
                  data_type IN ('TIMESTAMP', 'DATE', 'TIMESTAMP WITH TIME ZONE') AS isdate,
                  ({kw}) AS kw, ({idlike}) AS idlike
           FROM information_schema.columns WHERE table_name IN ({tables})),
v AS (SELECT table_name, arg_min(column_name, (CASE WHEN kw THEN 0 WHEN NOT idlike THEN 1 ELSE 2 END) * 1000 + pos) AS value_column
      FROM c WHERE isnum GROUP BY 1),
d AS (SELECT table_name, arg_min(column_name, pos) AS date_column FROM c WHERE isdate GROUP BY 1)
SELECT t.table_name, d.date_column, v.value_column
FROM (SELECT DISTINCT table_name FROM c) t LEFT JOIN v USING (table_name) LEFT JOIN d USING (table_name)"""


@register("value_column", _value_column_sql())
def q_value_column(spark, sf):
    """R9 (+ the date choice of F2): the columns a series of each driver table would use."""
    from ..functions.columns import datetime_typed_columns, numeric_columns

    rows = []
    for t in VALUE_TABLES:
        df = T_(spark, sf, t)
        dates = datetime_typed_columns(df)
        rows.append((t, dates[0] if dates else None, R.resolve_value_column(numeric_columns(df))))
    return spark.createDataFrame(rows, "table_name string, date_column string, value_column string")


@register("categorical_projection", "SELECT o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def q_categorical_projection(spark, sf):
    """R2: all rows of the columns that are not numeric."""
    return R.categorical_projection(T_(spark, sf, "orders"))


@register("value_column_totals", union_all([f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, round(sum(CAST({c} AS DOUBLE)), 2) AS total FROM {t}"
                                            for t, c in (("orders", "o_totalprice"), ("lineitem", "l_orderkey"), ("events", "value"))]))
def q_value_column_totals(spark, sf):
    """R9 over rows: the column that a series of each table sums, and its sum."""
    parts = []
    for name in ("orders", "lineitem", "events"):
        df = T_(spark, sf, name)
        chosen = R.resolve_value_column([c for c in P.numeric_columns(df)])
        parts.append(df.agg(F.count(chosen).alias("n"), F.round(F.sum(F.col(chosen).cast("double")), 2).alias("total"))
                     .select(F.lit(name).alias("table_name"), F.lit(chosen).alias("column_name"), "n", "total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
