"""Registered dashboard, advice, intent and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as A
from ..operators import dashboard as D
from ..operators import intent as I
from ..operators import report as G
from .catalog import T_, r6, register, rounded, union_all

LI_KPI = ["l_orderkey", "l_partkey", "l_suppkey"]


@register("kpis", "SELECT CAST(1 AS INTEGER) AS ord, 'row_count' AS id, 'Row count' AS label, "
          "CAST(count(*) AS DOUBLE) AS value FROM lineitem\nUNION ALL\n" + union_all(
              [f"SELECT CAST({2 + 2 * i} AS INTEGER), 'sum_{c}', 'Total {c}', {r6(f'sum(CAST({c} AS DOUBLE))')} FROM lineitem"
               f"\nUNION ALL\nSELECT CAST({3 + 2 * i} AS INTEGER), 'mean_{c}', 'Mean {c}', {r6(f'avg(CAST({c} AS DOUBLE))')} FROM lineitem"
               for i, c in enumerate(LI_KPI)]))
def q_kpis(spark, sf):
    return rounded(D.kpis(T_(spark, sf, "lineitem")).select(F.col("ord").cast("int"), "id", "label", "value"))


@register("margin_kpi", "SELECT 'l_orderkey' AS a, 'l_partkey' AS b, "
          "round(sum(coalesce(CAST(l_orderkey AS DOUBLE), 0)) - sum(coalesce(CAST(l_partkey AS DOUBLE), 0)), 4) AS value "
          "FROM lineitem")
def q_margin_kpi(spark, sf):
    return rounded(D.margin_kpi(T_(spark, sf, "lineitem")), 4)


@register("kpis_profit_loss", "SELECT CAST(1 AS INTEGER) AS ord, 'row_count' AS id, CAST(count(*) AS DOUBLE) AS value FROM orders "
          "UNION ALL SELECT 2, 'sum_o_orderkey', round(sum(CAST(o_orderkey AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 3, 'mean_o_orderkey', round(avg(CAST(o_orderkey AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 4, 'sum_o_custkey', round(sum(CAST(o_custkey AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 5, 'mean_o_custkey', round(avg(CAST(o_custkey AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 6, 'sum_o_totalprice', round(sum(CAST(o_totalprice AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 7, 'mean_o_totalprice', round(avg(CAST(o_totalprice AS DOUBLE)), 4) FROM orders "
          "UNION ALL SELECT 8, 'margin_proxy', round(sum(coalesce(CAST(o_orderkey AS DOUBLE), 0)) - "
          "sum(coalesce(CAST(o_custkey AS DOUBLE), 0)), 4) FROM orders")
def q_kpis_profit_loss(spark, sf):
    out = D.kpis(T_(spark, sf, "orders"), intent="profit_loss")
    return rounded(out.select(F.col("ord").cast("int"), "id", "value"), 4)


ORDERS_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@register("filter_options", "WITH long AS (" + union_all(
    [f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders WHERE {c} IS NOT NULL"
     for c in ORDERS_CAT]) + """)
SELECT column_name, CAST(ord AS INTEGER) AS ord, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS ord FROM long) WHERE ord <= 50""")
def q_filter_options(spark, sf):
    return D.filter_options(T_(spark, sf, "orders")).withColumn("ord", F.col("ord").cast("int"))


@register("date_bounds", "SELECT 'o_orderdate' AS column_name, CAST(min(o_orderdate) AS DATE) AS min_date, "
          "CAST(max(o_orderdate) AS DATE) AS max_date FROM orders")
def q_date_bounds(spark, sf):
    return D.date_bounds(T_(spark, sf, "orders"))


@register("apply_filters", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') "
          "AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1996-01-01' "
          "AND o_orderdate < DATE '1997-12-31' + INTERVAL 1 DAY")
def q_apply_filters(spark, sf):
    return D.apply_filters(T_(spark, sf, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"],
                                                     "no_such_column": ["x"], "o_custkey": []},
                           ("o_orderdate", "1996-01-01", "1997-12-31"))


@register("line_data", "SELECT o_orderdate, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders "
          "WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL")
def q_line_data(spark, sf):
    return D.line_data(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@register("bar_top25", """SELECT l_suppkey, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS l_extendedprice FROM lineitem
GROUP BY l_suppkey ORDER BY sum(l_extendedprice) DESC NULLS LAST, l_suppkey LIMIT 25""")
def q_bar_top25(spark, sf):
    return rounded(D.bar_data(T_(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice"), 2)


@register("pie_first8", """SELECT p_brand, round(sum(CAST(p_retailprice AS DOUBLE)), 4) AS p_retailprice FROM part
GROUP BY p_brand ORDER BY p_brand NULLS LAST LIMIT 8""")
def q_pie_first8(spark, sf):
    return rounded(D.pie_data(T_(spark, sf, "part"), "p_brand", "p_retailprice"), 4)


@register("scatter_data", "SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice "
          "FROM lineitem")
def q_scatter_data(spark, sf):
    return D.scatter_data(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("histogram", """
WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
             count(*) AS n FROM v, b GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, round(lo + s.bin * ((hi - lo) / 20), 6) AS lower,
       round(lo + (s.bin + 1) * ((hi - lo) / 20), 6) AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM b, range(0, 20) s(bin) LEFT JOIN c ON c.bin = s.bin""")
def q_histogram(spark, sf):
    return rounded(D.histogram(T_(spark, sf, "events"), "value"))


@register("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def q_preview(spark, sf):
    return D.preview(T_(spark, sf, "customer"))


# (condition, advice, chart, title, x, y, names, values, why as SQL)
_CHART_ROWS = [
    ("TRUE", "recommend", "line", "line: o_orderdate, o_orderkey", "o_orderdate", "o_orderkey", None, None,
     "'date o_orderdate, measure o_orderkey'"),
    ("TRUE", "recommend", "area", "area: o_orderdate, o_orderkey", "o_orderdate", "o_orderkey", None, None,
     "'date o_orderdate, measure o_orderkey'"),
    ("TRUE", "recommend", "bar", "bar: o_orderstatus, o_orderkey", "o_orderstatus", "o_orderkey", None, None,
     "'category o_orderstatus, measure o_orderkey'"),
    ("nd <= 8", "recommend", "pie", "pie: o_orderstatus, o_orderkey", None, None, "o_orderstatus", "o_orderkey",
     "'category o_orderstatus, measure o_orderkey; distinct values: ' || nd"),
    ("nd > 8", "avoid", "pie", None, None, None, None, None, "'category o_orderstatus, measure o_orderkey; distinct values: ' || nd"),
    ("TRUE", "recommend", "scatter", "scatter: o_orderkey, o_custkey", "o_orderkey", "o_custkey", None, None,
     "'measure o_orderkey, measure2 o_custkey'"),
    ("TRUE", "recommend", "heatmap", "heatmap", None, None, None, None, "'measure o_orderkey, measure2 o_custkey'"),
    ("TRUE", "recommend", "histogram", "histogram: o_orderkey", "o_orderkey", None, None, None, "'measure o_orderkey'"),
    ("TRUE", "avoid", "3d_pie", None, None, None, None, None, "'any table'"),
]


def _lit(v):
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


_CHART_SQL = "WITH nd AS (SELECT count(DISTINCT o_orderstatus) AS nd FROM orders), r AS (" + union_all(
    [f"SELECT {k} AS k, ({cond}) AS on_, {_lit(a)} AS advice, {_lit(c)} AS chart, {_lit(t)} AS title, {_lit(x)} AS x, "
     f"{_lit(y)} AS y, {_lit(n)} AS names, {_lit(v)} AS \"values\", {w} AS why FROM nd"
     for k, (cond, a, c, t, x, y, n, v, w) in enumerate(_CHART_ROWS)]) + ")"


@register("chart_advice", _CHART_SQL + """
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ord, advice, chart, title, x, y, names, "values", why
FROM r WHERE on_""")
def q_chart_advice(spark, sf):
    return A.chart_advice(T_(spark, sf, "orders")).withColumn("ord", F.col("ord").cast("int"))


@register("chart_specs", _CHART_SQL + """,
k AS (SELECT row_number() OVER (ORDER BY k) AS ord, * FROM r WHERE on_)
SELECT CAST(ord AS INTEGER) AS ord, chart, title, x, y, names, "values" FROM k WHERE advice = 'recommend' AND ord <= 8""")
def q_chart_specs(spark, sf):
    return D.chart_specs(T_(spark, sf, "orders")).withColumn("ord", F.col("ord").cast("int"))


@register("model_advice", """
WITH s AS (SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS nd FROM orders),
r AS (
  SELECT 'Forecasting' AS type, 0.9 AS score, 'date o_orderdate, measure o_orderkey' AS why, TRUE AS on_ FROM s
  UNION ALL SELECT 'Regresyon', 0.88, 'target o_orderkey; distinct values: ' || nd, nd > greatest(15, floor(n_rows * 0.05)) FROM s
  UNION ALL SELECT 'Sınıflandırma', 0.85, 'target o_orderkey; distinct values: ' || nd, nd <= greatest(15, floor(n_rows * 0.05)) FROM s
  UNION ALL SELECT 'Kümeleme', 0.7, 'measure o_orderkey, measure2 o_custkey', TRUE FROM s
  UNION ALL SELECT 'Anomali Tespiti', 0.65, 'measure o_orderkey, measure2 o_custkey', TRUE FROM s
  UNION ALL SELECT 'Recommendation System', 0.55, 'category o_orderstatus, subject o_orderkey', TRUE FROM s)
SELECT CAST(row_number() OVER (ORDER BY score DESC) AS INTEGER) AS rank, type, CAST(score AS DOUBLE) AS score, why
FROM r WHERE on_""")
def q_model_advice(spark, sf):
    return A.model_advice(T_(spark, sf, "orders")).withColumn("rank", F.col("rank").cast("int"))


@register("data_signals", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 3 AS numeric_columns, 3 AS categorical_columns, "
          "1 AS datetime_columns, 'o_orderkey,o_custkey,o_totalprice,o_orderpriority' AS target_candidates FROM orders")
def q_data_signals(spark, sf):
    return A.data_signals(T_(spark, sf, "orders"))


def _intent_sql_hits(kws, pats):
    terms = [f"CAST(contains(lower(trim(coalesce(text, ''))), '{k.lower()}') AS INTEGER)" for k in kws]
    terms += [f"CAST(regexp_matches(lower(trim(coalesce(text, ''))), '(?i){p}') AS INTEGER)" for p in pats]
    return " + ".join(terms)


_USER = "(SELECT conv_id, turn, text FROM conversations)"
_INTENT_ROWS = union_all([
    f"SELECT conv_id, turn, text AS query, '{name}' AS intent, {i} AS intent_ord, {_intent_sql_hits(k, p)} AS hits FROM {_USER} u"
    for i, (name, k, p, _) in enumerate(I.INTENTS)])


@register("intent_scores", f"""WITH s AS ({_INTENT_ROWS})
SELECT conv_id, turn, query, intent, intent_ord, hits, least(1.0, 0.35 + 0.2 * hits) AS score FROM s WHERE hits > 0""")
def q_intent_scores(spark, sf):
    c = T_(spark, sf, "conversations")
    return I.intent_scores(c, "text", ["conv_id", "turn"])


@register("primary_intent", f"""WITH s AS ({_INTENT_ROWS}),
h AS (SELECT *, least(1.0, 0.35 + 0.2 * hits) AS score FROM s WHERE hits > 0),
b AS (SELECT conv_id, turn, arg_max(intent, score * 100 - intent_ord) AS intent, max(score) AS score FROM h GROUP BY 1, 2)
SELECT u.conv_id, u.turn, u.text AS query,
  CASE WHEN length(trim(coalesce(u.text, ''))) = 0 OR b.intent IS NULL THEN 'general_analysis' ELSE b.intent END AS primary_intent,
  CASE WHEN length(trim(coalesce(u.text, ''))) = 0 THEN 0.5 WHEN b.intent IS NULL THEN 0.4 ELSE b.score END AS confidence
FROM {_USER} u LEFT JOIN b USING (conv_id, turn)""")
def q_primary_intent(spark, sf):
    c = T_(spark, sf, "conversations")
    return I.primary_intent(c, "text", ["conv_id", "turn"]).drop("matched")


def _task_values() -> str:
    rows = []
    for i, (name, _, _, ts) in enumerate(I.INTENTS):
        for pos, (tid, title, agent) in enumerate(ts):
            rows.append(f"('{name}', {pos}, '{tid}', '{title}', '{agent}')")
    return "(VALUES " + ", ".join(rows) + ") tt(intent, pos, task_id, title, agent)"


@register("intent_tasks", f"""WITH s AS ({_INTENT_ROWS}),
h AS (SELECT conv_id, turn, intent, intent_ord, least(1.0, 0.35 + 0.2 * hits) AS score FROM s WHERE hits > 0),
m AS (SELECT u.conv_id, u.turn, u.text AS query, coalesce(h.intent, 'general_analysis') AS intent,
             CASE WHEN length(trim(coalesce(u.text, ''))) = 0 OR h.intent IS NULL THEN 0
                  ELSE row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY h.score DESC, h.intent_ord) END AS irank
      FROM {_USER} u LEFT JOIN h ON u.conv_id = h.conv_id AND u.turn = h.turn
      WHERE NOT (length(trim(coalesce(u.text, ''))) = 0 AND h.intent IS NOT NULL)),
t AS (SELECT m.conv_id, m.turn, m.query, m.irank, tt.pos, tt.task_id, tt.title, tt.agent
      FROM m JOIN {_task_values()} ON m.intent = tt.intent),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, task_id ORDER BY irank, pos) AS first_seen FROM t)
SELECT conv_id, turn, query, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY irank, pos) AS INTEGER) AS task_rank,
       task_id, title, agent
FROM f WHERE first_seen = 1""")
def q_intent_tasks(spark, sf):
    c = T_(spark, sf, "conversations")
    return I.intent_tasks(c, "text", ["conv_id", "turn"]).withColumn("task_rank", F.col("task_rank").cast("int"))


@register("report_lines")
def q_report_lines(spark, sf):
    """G1 + G6 with the notes of the whole suite and a forecast (candidates that need no tree fits)."""
    from ..operators import forecast as FC
    from ..operators import stats as S
    from .shared import Shared

    df = T_(spark, sf, "orders")
    shared = Shared(df)
    bundle = FC.forecast(df, "o_orderdate", "o_totalprice", models=["NaiveLast", "ARIMA"])
    return G.report_lines(df, "Satış analizi yap", "orders", bundle["choice"], bundle["series"], S.notes(S.statistics(df, shared=shared)), shared)


@register("analysis_summary")
def q_analysis_summary(spark, sf):
    """G7 + S11: the end-to-end analysis of orders with every section and a forecast, as JSON lines."""
    from .analyze import analyze, summary

    return summary(analyze(T_(spark, sf, "orders"), "Satış analizi yap", "orders", forecast_models=["NaiveLast", "ARIMA"]))


@register("stream_kpis", "SELECT CAST(count(*) AS BIGINT) AS rows, "
          "round(sum(CAST(event_id AS DOUBLE)), 4) AS sum_event_id, round(avg(CAST(event_id AS DOUBLE)), 6) AS mean_event_id, "
          "round(sum(CAST(user_id AS DOUBLE)), 4) AS sum_user_id, round(avg(CAST(user_id AS DOUBLE)), 6) AS mean_user_id, "
          "round(sum(value), 4) AS sum_value, round(avg(value), 6) AS mean_value FROM events")
def q_stream_kpis(spark, sf):
    """D1-D2 maintained by Structured Streaming over the events files (state store, complete mode)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.live import running_kpis

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream watches a folder: the table's folder, filtered to this table's files
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"kpis_{uuid.uuid4().hex[:8]}"
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    q = (running_kpis(stream).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.table(name)
    cols = [c for c in out.columns]
    return out.select(*[F.round(c, 6 if c.startswith("mean") else 4).alias(c) if c != "rows" else F.col(c) for c in cols])
