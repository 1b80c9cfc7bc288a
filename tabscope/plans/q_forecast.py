"""Registered forecasting queries (F9-F12, F16-F17, F22) on weekly order revenue per priority.

Model fits are not SQL-expressible: these are rows-only checks, with the
models' pieces unit-tested separately.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import series as TS
from ..operators.ordered import stable
from .catalog import T_, register, rounded
from .q_series import _series_cte

K = "o_orderpriority"


def _weekly(spark, sf):
    o = T_(spark, sf, "orders")
    return TS.recent(TS.time_series(o, "o_orderdate", "o_totalprice", [K], frequency="W"), [K])


@register("arima_forecast")
def q_arima_forecast(spark, sf):
    ser = _weekly(spark, sf)
    choice = ser.select(K).distinct().withColumn("model", F.lit("ARIMA"))
    return rounded(FC.forecast_points(ser, choice, [K]), 4)


@register("arima_backtest")
def q_arima_backtest(spark, sf):
    return rounded(TS.metrics(FC.arima_backtest(_weekly(spark, sf), [K]), [K]), 4)


@register("forest_forecast")
def q_forest_forecast(spark, sf):
    ser = _weekly(spark, sf)
    metrics = TS.metrics(FC.ml_backtest(ser, [K], ["RandomForest"]), [K])
    tables = FC.final_models(ser, [K], ["RandomForest"])
    pts = FC.forecast_points(ser, metrics.select(K, "model"), [K], tables)
    return rounded(pts.join(metrics.select(K, "rmse", "mae", "r2"), K), 4)


@register("boosting_forecast")
def q_boosting_forecast(spark, sf):
    """Backtest metrics of both boosting candidates beside each one's points on every horizon."""
    ser = stable(_weekly(spark, sf))
    models = ["XGBoost", "LightGBM"]
    metrics = TS.metrics(FC.ml_backtest(ser, [K], models), [K])
    tables = FC.final_models(ser, [K], models)
    keys = ser.select(K).distinct()
    pts = [FC.forecast_points(ser, keys.withColumn("model", F.lit(m)), [K], tables) for m in models]
    return rounded(pts[0].unionByName(pts[1]).join(metrics.select(K, "model", "rmse", "mae", "r2"), [K, "model"]), 4)


@register("pooled_folds", f"""WITH {_series_cte('orders', 'W')},
ix AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bucket) - 1 AS idx, count(*) OVER (PARTITION BY {K}) AS n FROM ser),
lr AS (SELECT *, idx - least(7, greatest(3, n // 10)) AS r, n - least(7, greatest(3, n // 10)) AS m, least(3, greatest(2, n // 10)) AS k FROM ix),
fo AS (SELECT lr.*, fold, m - (k - fold) * (m // (k + 1)) AS s, m - (k - fold) * (m // (k + 1)) + m // (k + 1) AS e FROM lr, range(0, 3) f(fold) WHERE r >= 0 AND fold < k),
cu AS (SELECT fold, min(bucket) AS cut FROM fo WHERE r = s GROUP BY fold)
SELECT {K}, CAST(fold AS INTEGER) AS fold, cut, CAST(count(*) FILTER (WHERE bucket < cut) AS BIGINT) AS n_train, max(bucket) FILTER (WHERE bucket < cut) AS last_train,
       CAST(count(*) FILTER (WHERE r >= s AND r < e) AS BIGINT) AS n_test, min(bucket) FILTER (WHERE r >= s AND r < e) AS first_test
FROM fo JOIN cu USING (fold) GROUP BY {K}, fold, cut""")
def q_pooled_folds(spark, sf):
    """What each pooled fold learns on and predicts: no training row is later than any test row."""
    rows = FC.pooled_folds(TS.time_series(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice", [K], frequency="W"), [K])
    known, test = F.col("bucket") < F.col("cut"), (F.col("r") >= F.col("test_start")) & (F.col("r") < F.col("test_end"))
    return rows.groupBy(K, "fold", "cut").agg(F.count_if(known).alias("n_train"), F.max(F.when(known, F.col("bucket"))).alias("last_train"),
                                              F.count_if(test).alias("n_test"), F.min(F.when(test, F.col("bucket"))).alias("first_test"))


@register("model_choice")
def q_model_choice(spark, sf):
    ser = _weekly(spark, sf)
    met = TS.metrics(FC.backtest(ser, [K]), [K])
    return rounded(TS.choose(met, [K]), 4)


@register("forecast_points")
def q_forecast_points(spark, sf):
    """Points of the whole bundle: every candidate is backtested, each key's best one fitted on all its buckets."""
    o = T_(spark, sf, "orders")
    return rounded(FC.forecast(o, "o_orderdate", "o_totalprice", [K], frequency="W")["points"], 4)
