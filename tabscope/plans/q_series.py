"""Registered time-series queries (F1-F8, F13-F16, F19-F21) on orders by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as TS
from . import fixtures as fx
from .catalog import T_, register, rounded, sig, sig_sql

K = "o_orderpriority"
OG = fx.SQL["orders_gappy"]


def _freq_sql(src: str, key: str, tcol: str) -> str:
    return f"""
d AS (SELECT DISTINCT {key}, {tcol} AS t FROM {src} WHERE {tcol} IS NOT NULL),
g AS (SELECT {key}, t, lag(t) OVER (PARTITION BY {key} ORDER BY t) AS prev FROM d),
m AS (SELECT {key}, quantile_cont(CAST(floor(date_diff('microsecond', prev, t) / 86400000000.0) AS DOUBLE), 0.5) AS med
      FROM g WHERE prev IS NOT NULL GROUP BY 1),
c AS (SELECT {key}, count(*) AS n_dates FROM d GROUP BY 1),
fq AS (SELECT c.{key}, CAST(n_dates AS BIGINT) AS n_dates, CASE WHEN n_dates >= 3 THEN med END AS median_gap,
       CASE WHEN n_dates < 3 THEN 'unknown' WHEN med <= 1.5 THEN 'daily' WHEN med <= 8 THEN 'weekly'
            WHEN med <= 35 THEN 'monthly' WHEN med <= 400 THEN 'yearly' ELSE 'irregular' END AS frequency,
       CASE WHEN n_dates < 3 THEN 'D' WHEN med <= 1.5 THEN 'D' WHEN med <= 8 THEN 'W'
            WHEN med <= 35 THEN 'MS' WHEN med <= 400 THEN 'YS' ELSE 'D' END AS unit
      FROM c LEFT JOIN m USING ({key}))"""


@register("detect_frequency", f"WITH {_freq_sql('orders', K, 'o_orderdate')} SELECT * FROM fq")
def q_detect_frequency(spark, sf):
    return TS.detect_frequency(T_(spark, sf, "orders"), "o_orderdate", [K])


@register("detect_frequency_events", f"WITH {_freq_sql('events', 'event_type', 'ts')} SELECT * FROM fq")
def q_detect_frequency_events(spark, sf):
    return TS.detect_frequency(T_(spark, sf, "events"), "ts", ["event_type"])


_BUCKET = {
    "D": "CAST(date_trunc('day', t) AS TIMESTAMP)",
    "W": "CAST(date_trunc('week', t) + INTERVAL 6 DAY AS TIMESTAMP)",
    "MS": "CAST(date_trunc('month', t) AS TIMESTAMP)",
}
_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "MS": "INTERVAL 1 MONTH"}
_LABEL = {"D": "daily", "W": "weekly", "MS": "monthly"}


def _series_cte(src: str, unit: str, fill: str = "zero") -> str:
    value = "coalesce(s.value, 0.0)" if fill == "zero" else "s.value"
    return f"""
raw AS (SELECT {K}, o_orderdate AS t, CAST(o_totalprice AS DOUBLE) AS v FROM {src}
        WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
ok AS (SELECT {K} FROM raw GROUP BY 1 HAVING count(*) >= 12),
s AS (SELECT {K}, {_BUCKET[unit]} AS bucket, sum(v) AS value FROM raw WHERE {K} IN (SELECT {K} FROM ok) GROUP BY ALL),
b AS (SELECT {K}, min(bucket) AS f, max(bucket) AS l FROM s GROUP BY 1),
sp AS (SELECT {K}, unnest(generate_series(f, l, {_STEP[unit]})) AS bucket FROM b),
ser0 AS (SELECT sp.{K}, sp.bucket, {value} AS value FROM sp LEFT JOIN s USING ({K}, bucket)),
ser AS (SELECT *, '{_LABEL[unit]}' AS frequency, '{unit}' AS unit FROM ser0
        WHERE {K} IN (SELECT {K} FROM ser0 GROUP BY 1 HAVING count(*) >= 12))"""


def _series_out(src: str = "ser") -> str:
    return f"SELECT {K}, bucket, round(value, 4) AS value, frequency, unit FROM {src}"


def _spark_series(spark, sf, unit=None, table="orders", fill="zero"):
    src = T_(spark, sf, "orders") if table == "orders" else fx.orders_gappy(spark, sf)
    return TS.time_series(src, "o_orderdate", "o_totalprice", [K], frequency=unit, fill=fill)


@register("daily_series", f"WITH {_series_cte('orders', 'D')} {_series_out()}")
def q_daily_series(spark, sf):
    return rounded(_spark_series(spark, sf), 4)


@register("weekly_series", f"WITH {_series_cte('orders', 'W')} {_series_out()}")
def q_weekly_series(spark, sf):
    return rounded(_spark_series(spark, sf, "W"), 4)


@register("monthly_series", f"WITH {_series_cte('orders', 'MS')} {_series_out()}")
def q_monthly_series(spark, sf):
    return rounded(_spark_series(spark, sf, "MS"), 4)


@register("gap_fill", f"WITH {_series_cte(OG, 'D')} {_series_out()}")
def q_gap_fill(spark, sf):
    return rounded(_spark_series(spark, sf, table="gappy"), 4)


@register("interpolate", f"""WITH {_series_cte(OG, 'D', fill='null')},
ix AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bucket) - 1 AS idx FROM ser),
nb AS (SELECT *,
  last_value(value IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(value IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM ix)
SELECT {K}, bucket, round(CASE WHEN value IS NOT NULL THEN value
  WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * (idx - pi) / (ni - pi)
  ELSE coalesce(pv, nv) END, 4) AS value, frequency, unit FROM nb""")
def q_interpolate(spark, sf):
    s = _spark_series(spark, sf, table="gappy", fill="null")
    return rounded(TS.interpolate(s, [K]), 4)


_INDEXED = f"""ix AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bucket) - 1 AS idx,
                  count(*) OVER (PARTITION BY {K}) AS n FROM ser)"""


@register("recent_points", f"""WITH {_series_cte('orders', 'D')},
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bucket DESC) AS rn FROM ser)
SELECT {K}, bucket, round(value, 4) AS value, frequency, unit FROM r WHERE rn <= 3000""")
def q_recent_points(spark, sf):
    return rounded(TS.recent(_spark_series(spark, sf), [K]), 4)


@register("recent_points_500", f"""WITH {_series_cte('orders', 'D')},
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bucket DESC) AS rn FROM ser)
SELECT {K}, bucket, round(value, 4) AS value, frequency, unit FROM r WHERE rn <= 500""")
def q_recent_points_500(spark, sf):
    """F5 with a limit that every series exceeds (the feature)."""
    return rounded(TS.recent(_spark_series(spark, sf), [K], 500), 4)


@register("lag_features", f"""WITH {_series_cte('orders', 'D')}, {_INDEXED},
l AS (SELECT *, CAST(least(7, greatest(3, n // 10)) AS INTEGER) AS n_lags FROM ix)
SELECT {K}, bucket, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n, n_lags, round(value, 4) AS value,
  {', '.join(f"round(CASE WHEN {k} <= n_lags THEN lag(value, {k}) OVER (PARTITION BY {K} ORDER BY idx) END, 4) AS lag_{k}" for k in range(1, 8))}
FROM l QUALIFY idx >= n_lags""")
def q_lag_features(spark, sf):
    out = TS.lag_features(_spark_series(spark, sf), [K])
    return rounded(out.select(K, "bucket", "idx", "n", "n_lags", "value", *[f"lag_{k}" for k in range(1, 8)]), 4)


_FOLDS = f"""ln AS (SELECT {K}, count(*) AS n FROM ser GROUP BY 1),
fk AS (SELECT {K}, n, CAST(least(3, greatest(2, n // 10)) AS INTEGER) AS n_folds FROM ln),
fs AS (SELECT {K}, n, n_folds, CAST(n // (n_folds + 1) AS BIGINT) AS test_size FROM fk),
fo AS (SELECT {K}, CAST(fold AS INTEGER) AS fold, n_folds, test_size,
              CAST(n - (n_folds - fold) * test_size AS BIGINT) AS test_start,
              CAST(n - (n_folds - fold) * test_size + test_size AS BIGINT) AS test_end
       FROM fs, range(0, 3) r(fold) WHERE fold < n_folds AND test_size > 0)"""


@register("folds", f"WITH {_series_cte('orders', 'D')}, {_FOLDS} SELECT * FROM fo")
def q_folds(spark, sf):
    s = TS.with_index(_spark_series(spark, sf), [K])
    lens = s.groupBy(K).agg(F.max("n").alias("n"))
    return TS.folds(lens, [K])


_NAIVE = f"""{_INDEXED}, {_FOLDS},
bt AS (SELECT t.{K}, 'NaiveLast' AS model, fo.fold, t.bucket, t.value AS y, p.value AS yhat
       FROM ix t JOIN fo ON t.{K} = fo.{K} AND t.idx >= fo.test_start AND t.idx < fo.test_end
       JOIN ix p ON p.{K} = t.{K} AND p.idx = fo.test_start - 1)"""


@register("naive_backtest", f"""WITH {_series_cte('orders', 'D')}, {_NAIVE}
SELECT {K}, model, fold, bucket, round(y, 4) AS y, round(yhat, 4) AS yhat FROM bt""")
def q_naive_backtest(spark, sf):
    return rounded(TS.naive_backtest(_spark_series(spark, sf), [K]), 4)


_METRICS = f"""mt AS (SELECT {K}, model, CAST(count(*) AS BIGINT) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
  avg(abs(y - yhat) / greatest(abs(y), 1e-8)) * 100 AS mape,
  avg(abs(y - yhat) / greatest((abs(y) + abs(yhat)) / 2.0, 1e-8)) * 100 AS smape,
  sum((y - yhat) * (y - yhat)) AS sse, var_pop(y) * count(*) AS sst FROM bt GROUP BY 1, 2)"""


@register("forecast_metrics", f"""WITH {_series_cte('orders', 'D')}, {_NAIVE}, {_METRICS}
SELECT {K}, model, n, round(mae, 4) AS mae, {sig_sql('mse')} AS mse, round(sqrt(mse), 4) AS rmse,
       {sig_sql('mape')} AS mape, round(smape, 6) AS smape,
       round(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2 FROM mt""")
def q_forecast_metrics(spark, sf):
    m = TS.metrics(TS.naive_backtest(_spark_series(spark, sf), [K]), [K])
    return m.select(K, "model", "n", F.round("mae", 4).alias("mae"), sig(F.col("mse")).alias("mse"),
                    F.round("rmse", 4).alias("rmse"), sig(F.col("mape")).alias("mape"),
                    F.round("smape", 6).alias("smape"), F.round("r2", 6).alias("r2"))


_HZ = "(VALUES ('1w', 7, 0), ('1m', 30, 1), ('3m', 90, 2), ('6m', 180, 3), ('1y', 365, 4)) hz(horizon, days, h_ord)"


@register("forecast_horizons", f"""WITH {_freq_sql('orders', K, 'o_orderdate')}
SELECT {K}, unit, horizon, CAST(days AS INTEGER) AS days, CAST(h_ord AS INTEGER) AS h_ord,
  CAST(greatest(1, round_even(days / CASE unit WHEN 'W' THEN 7 WHEN 'MS' THEN 30 WHEN 'YS' THEN 365 ELSE 1 END, 0)) AS INTEGER) AS steps
FROM fq, {_HZ}""")
def q_forecast_horizons(spark, sf):
    fq = TS.detect_frequency(T_(spark, sf, "orders"), "o_orderdate", [K])
    return TS.horizon_steps(fq, [K])


@register("naive_forecast", f"""WITH {_series_cte('orders', 'W')},
lst AS (SELECT {K}, arg_max(value, bucket) AS last_value, max(bucket) AS last FROM ser GROUP BY 1),
st AS (SELECT {K}, horizon, CAST(greatest(1, round_even(days / 7.0, 0)) AS INTEGER) AS steps FROM lst, {_HZ})
SELECT st.{K}, horizon, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 7 DAY AS TIMESTAMP) AS bucket,
       round(last_value, 4) AS value
FROM st JOIN lst USING ({K}), range(1, 53) r(step) WHERE step <= steps""")
def q_naive_forecast(spark, sf):
    return rounded(TS.naive_forecast(_spark_series(spark, sf, "W"), [K]), 4)


@register("series_status", f"""SELECT {K}, CAST(count(*) AS BIGINT) AS n_raw, count(*) >= 12 AS available,
  CASE WHEN count(*) >= 12 THEN NULL ELSE 'fewer than 12 points' END AS reason
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1""")
def q_series_status(spark, sf):
    return TS.series_status(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice", [K])
