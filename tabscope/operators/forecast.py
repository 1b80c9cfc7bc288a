"""Forecast models, backtests, selection and multi-horizon forecasts.

* NaiveLast and the metrics are plain relational work (``series``).
* ARIMA(1,1,1) is fitted per series (conditional sum of squares) inside
  ``applyInPandas``; a group is one series of buckets (as long as its time span, see ``recent`` for a limit).
* Random forest and the two gradient-boosting configurations are Spark ML
  estimators trained on the lag rows of *all* series pooled (values scaled
  by each series' training rows), one fit per backtest fold, fits submitted
  concurrently. A candidate that cannot be fitted is left out with a warning.
* The recursive multi-step forecast feeds each prediction back as a lag.
  Looping Spark jobs per step would not scale, so the fitted trees are
  written as node tables (Spark ML's own model format), read back (their
  size is bounded by trees x nodes, not by data) and evaluated inside the
  per-series grouped map.
"""

from __future__ import annotations

import logging
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .ordered import null_safe_join, stable
from . import series as TS

# Model settings of the reference's candidates.
# Depth 12 stands for fully grown trees: it bounds the node table (8,191 nodes a tree) whatever the number of rows.
FOREST = {"backtest_trees": 120, "final_trees": 200, "depth": 12, "seed": 42}
BOOST_A = {"backtest_iter": 150, "final_iter": 200, "depth": 4, "rate": 0.08, "seed": 42, "subsample": 1.0}
BOOST_B = {"backtest_iter": 150, "final_iter": 200, "depth": 5, "rate": 0.08, "seed": 42, "subsample": 0.8}
ML_MODELS = {"RandomForest": FOREST, "XGBoost": BOOST_A, "LightGBM": BOOST_B}
MAX_LAGS = 7
LOG = logging.getLogger(__name__)


# ---------------------------------------------------------------- ARIMA(1,1,1)

def _css_residuals(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Residuals of d_t = phi d_{t-1} + e_t + theta e_{t-1} for many (phi, theta) at once."""
    e_prev = np.zeros_like(phi)
    sse = np.zeros_like(phi)
    for t in range(1, len(d)):
        e = d[t] - phi * d[t - 1] - theta * e_prev
        sse += e * e
        e_prev = e
    return sse


def arima_fit(y: np.ndarray) -> tuple[float, float, float, float]:
    """(phi, theta, last_diff, last_resid) by conditional sum of squares on the first difference."""
    d = np.diff(np.asarray(y, dtype=float))
    if len(d) < 3:
        return 0.0, 0.0, float(d[-1]) if len(d) else 0.0, 0.0
    scale = np.std(d) or 1.0
    dz = d / scale
    grid = np.linspace(-0.95, 0.95, 39)
    phi, theta = np.meshgrid(grid, grid)
    phi, theta = phi.ravel(), theta.ravel()
    sse = _css_residuals(dz, phi, theta)
    best = int(np.argmin(sse))
    p0, t0 = phi[best], theta[best]
    fine = np.linspace(-0.05, 0.05, 21)
    fp, ft = np.meshgrid(np.clip(p0 + fine, -0.99, 0.99), np.clip(t0 + fine, -0.99, 0.99))
    fp, ft = fp.ravel(), ft.ravel()
    sse2 = _css_residuals(dz, fp, ft)
    best = int(np.argmin(sse2))
    p, th = float(fp[best]), float(ft[best])
    e_prev = 0.0
    for t in range(1, len(d)):
        e_prev = d[t] - p * d[t - 1] - th * e_prev
    return p, th, float(d[-1]), float(e_prev)


def arima_predict(y: np.ndarray, steps: int) -> np.ndarray:
    p, th, d_last, e_last = arima_fit(y)
    out, level, dprev = [], float(y[-1]), d_last
    for h in range(steps):
        dh = p * dprev + (th * e_last if h == 0 else 0.0)
        level += dh
        out.append(level)
        dprev = dh
    return np.asarray(out)


def _fold_bounds(n: int) -> list[tuple[int, int]]:
    k = min(3, max(2, n // 10))
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i) * size + size) for i in range(k)] if size > 0 else []


def arima_backtest(series: DataFrame, keys: list[str]) -> DataFrame:
    """F9 backtest: per series, every fold refits on the prefix and forecasts the test window."""
    eff = keys or ["_all"]
    src = series if keys else series.withColumn("_all", F.lit(0))
    kf = [f for f in src.schema.fields if f.name in eff]
    schema = T.StructType(kf + [T.StructField("model", T.StringType()), T.StructField("fold", T.IntegerType()),
                                T.StructField("bucket", src.schema["bucket"].dataType),
                                T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType())])
    names = eff + ["model", "fold", "bucket", "y", "yhat"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket").reset_index(drop=True)
        y = pdf["value"].to_numpy(dtype=float)
        kv = [pdf[k].iloc[0] for k in eff]
        rows = []
        for i, (s, e) in enumerate(_fold_bounds(len(y))):
            pred = arima_predict(y[:s], e - s)
            for j in range(s, e):
                rows.append(kv + ["ARIMA", i, pdf["bucket"].iloc[j], y[j], float(pred[j - s])])
        return pd.DataFrame(rows, columns=names)

    out = src.select(*eff, "bucket", "value").groupBy(*eff).applyInPandas(run, schema)
    return out.drop("_all") if not keys else out


# ------------------------------------------------------------- pooled trees

def _lag_rows(series: DataFrame, keys: list[str]) -> DataFrame:
    """Lag rows with their position ``r`` among the series' ``n_rows`` lag rows."""
    lf = TS.lag_features(series, keys, MAX_LAGS)
    return lf.withColumn("r", F.col("idx") - F.col("n_lags")).withColumn("n_rows", F.col("n") - F.col("n_lags"))


def _scaled(lag: DataFrame, by: list[str], known: Column, own: Column | None = None) -> DataFrame:
    """Features and label over ``scale``, the mean absolute value of the ``known`` rows of each group, or of its ``own``
    rows where it has no known one."""
    means = lag.groupBy(*by).agg(F.avg(F.when(known, F.abs("value"))).alias("_known"), F.avg(F.when(own if own is not None else known, F.abs("value"))).alias("_own"))
    means = means.select(*by, F.coalesce("_known", "_own").alias("_scale"))
    lag = null_safe_join(lag, means, by) if by else lag.crossJoin(F.broadcast(means))
    lag = lag.withColumn("scale", F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(F.lit(1.0))).drop("_scale")
    feats = [F.coalesce(F.col(f"lag_{k}") / F.col("scale"), F.lit(-1.0)).alias(f"f{k}") for k in range(1, MAX_LAGS + 1)]
    return lag.select("*", *feats, (F.col("value") / F.col("scale")).alias("label"))


def _assemble(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = [f"f{k}" for k in range(1, MAX_LAGS + 1)] + ["n_lags"]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df.withColumn("n_lags", F.col("n_lags").cast("double")))


def _estimator(model: str, final: bool):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    cfg = ML_MODELS[model]
    if model == "RandomForest":
        return RandomForestRegressor(labelCol="label", featuresCol="features", maxDepth=cfg["depth"], minInstancesPerNode=1,
                                     featureSubsetStrategy="all", numTrees=cfg["final_trees"] if final else cfg["backtest_trees"], seed=cfg["seed"])
    return GBTRegressor(labelCol="label", featuresCol="features", maxIter=cfg["final_iter"] if final else cfg["backtest_iter"],
                        maxDepth=cfg["depth"], stepSize=cfg["rate"], subsamplingRate=cfg["subsample"], seed=cfg["seed"])


def pooled_folds(series: DataFrame, keys: list[str]) -> DataFrame:
    """Lag rows by fold, with each series' own test window (positions test_start to test_end among its lag rows) and ``cut``.

    ``cut`` is the earliest first test date of the fold over all series. A model pooled over the series learns on rows
    before it alone, so that it sees no row of any series that is later than what it has to predict. Where series end at
    very different times, the earliest one thus decides how much history a fold has.
    """
    lag = _lag_rows(series, keys)
    lens = lag.groupBy(*keys).agg(F.max("n").alias("n"), F.max("n_rows").alias("n_rows"))
    fl = TS.folds(lens, keys, n_col="n_rows", count_col="n")
    tagged = null_safe_join(lag, fl, keys) if keys else lag.crossJoin(F.broadcast(fl))
    cuts = tagged.where(F.col("r") == F.col("test_start")).groupBy("fold").agg(F.min("bucket").alias("cut"))
    return tagged.join(F.broadcast(cuts), "fold")  # at most three rows


def ml_backtest(series: DataFrame, keys: list[str], models: list[str] | None = None) -> DataFrame:
    """F10-F12 backtests: per fold index one pooled fit per model on the rows before the fold's cut date; each series'
    test rows predicted.

    The expanding split cuts each series' lag rows into as many folds as the series' length asks for (series with fewer
    folds skip fold 2). Values are scaled by the series' rows before the cut, or before its own test window if the cut is
    earlier than the series.
    """
    models = models or list(ML_MODELS)
    before_cut = F.col("bucket") < F.col("cut")
    scaled = _scaled(pooled_folds(series, keys), [*keys, "fold"], before_cut, F.col("r") < F.col("test_start"))
    data = stable(_assemble(scaled).select(*keys, "bucket", "value", "scale", "fold", "r", "test_start", "test_end", "cut",
                                           "features", "label"))
    jobs = [(m, f) for m in models for f in range(3)]

    def fit_predict(job):
        m, f = job
        part = data.where(F.col("fold") == f)
        train = part.where(before_cut)
        test = part.where((F.col("r") >= F.col("test_start")) & (F.col("r") < F.col("test_end")))
        if train.isEmpty() or test.isEmpty():
            return None
        return _estimator(m, final=False).fit(train).transform(test).select(
            *keys, F.lit(m).alias("model"), F.col("fold").cast("int").alias("fold"), "bucket", F.col("value").alias("y"),
            (F.col("prediction") * F.col("scale")).alias("yhat"))

    parts = _tolerant(fit_predict, jobs)
    # a candidate counts only with all its folds
    failed = {m for (m, _), ok, _ in parts if not ok}
    out = data.where(F.lit(False)).select(*keys, F.lit("").alias("model"), F.col("fold").cast("int").alias("fold"), "bucket",
                                          F.col("value").alias("y"), F.col("value").alias("yhat"))
    for (m, _), _, rows in parts:
        if rows is not None and m not in failed:
            out = out.unionByName(rows)
    return out


def _tolerant(fit, jobs: list) -> list[tuple]:
    """(job, succeeded, result) of each job, run at the same time; a failed fit is logged."""
    def run(job):
        try:
            return job, True, fit(job)
        except Exception as exc:  # noqa: BLE001 - one candidate must not stop the others
            LOG.warning("%s could not be fitted: %s", job, exc)
            return job, False, None

    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return list(pool.map(run, jobs))


def _node_table(model, spark) -> dict:
    """Write a fitted tree ensemble in Spark ML's format and read its nodes back as arrays."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("thr")
    ).toPandas()
    from pyspark.ml.regression import RandomForestRegressionModel

    forest = isinstance(model, RandomForestRegressionModel)  # predicts the mean of its trees; boosting the weighted sum
    # nodes of all trees one after another; ids count from 0 in each tree
    nodes = nodes.sort_values(["treeID", "id"])
    sizes = nodes.groupby("treeID").size()
    start = (sizes.cumsum() - sizes).reindex(nodes["treeID"]).to_numpy()
    inner = nodes["leftChild"].to_numpy() >= 0
    own = np.arange(len(nodes))
    if forest:
        weight = np.full(len(sizes), 1.0 / len(sizes))
    else:
        meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_m", "weight").select("treeID", "weight").toPandas()
        weight = meta.set_index("treeID")["weight"].reindex(sizes.index).to_numpy()
    return {"feature": nodes["featureIndex"].fillna(-1).to_numpy(dtype=int), "threshold": nodes["thr"].fillna(0.0).to_numpy(),
            "left": np.where(inner, start + nodes["leftChild"].to_numpy(), own),
            "right": np.where(inner, start + nodes["rightChild"].to_numpy(), own),
            "value": nodes["prediction"].to_numpy(), "root": (sizes.cumsum() - sizes).to_numpy(), "weight": weight}


def _eval_trees(table: dict, x: np.ndarray) -> float:
    """Prediction for one feature vector: all trees go down one level at a time; leaves point to themselves."""
    node = table["root"]
    while True:
        child = np.where(x[table["feature"][node]] <= table["threshold"][node], table["left"][node], table["right"][node])
        if np.array_equal(child, node):
            return float(table["weight"] @ table["value"][node])
        node = child


# ----------------------------------------------------------- selection + final

def backtest(series: DataFrame, keys: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """All candidates' backtest rows (keys..., model, fold, bucket, y, yhat)."""
    keys = keys or []
    models = models or TS.MODEL_ORDER
    parts = []
    if "NaiveLast" in models:
        parts.append(TS.naive_backtest(series, keys))
    if "ARIMA" in models:
        parts.append(arima_backtest(series, keys))
    ml = [m for m in models if m in ML_MODELS]
    if ml:
        parts.append(ml_backtest(series, keys, ml))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def final_models(series: DataFrame, keys: list[str], models: list[str]) -> dict[str, dict]:
    """Fit each tree model on all lag rows (pooled) and return its node arrays; one that fails is left out."""
    if not models:
        return {}
    lag = stable(_assemble(_scaled(_lag_rows(series, keys), keys, F.lit(True))).select("features", "label"))
    spark = series.sparkSession
    return {m: table for m, ok, table in _tolerant(lambda m: _node_table(_estimator(m, final=True).fit(lag), spark), models) if ok}


def forecast_points(series: DataFrame, choice: DataFrame, keys: list[str] | None = None,
                    tables: dict[str, dict] | None = None) -> DataFrame:
    """F17 + F19 + F20: (keys..., model, horizon, step, bucket, value) for each key's chosen model.

    The longest horizon is forecast once per key; shorter horizons are its
    prefixes. NaiveLast carries the last value forward.
    """
    keys = keys or []
    eff = keys or ["_all"]
    tables = tables or {}
    src = series if keys else series.withColumn("_all", F.lit(0))
    ch = choice if keys else choice.withColumn("_all", F.lit(0))
    joined = src.join(ch.select(*eff, "model"), eff)
    kf = [f for f in src.schema.fields if f.name in eff]
    schema = T.StructType(kf + [T.StructField("model", T.StringType()), T.StructField("horizon", T.StringType()),
                                T.StructField("step", T.IntegerType()),
                                T.StructField("bucket", src.schema["bucket"].dataType),
                                T.StructField("value", T.DoubleType())])
    names = eff + ["model", "horizon", "step", "bucket", "value"]
    unit_days = TS.UNIT_DAYS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket").reset_index(drop=True)
        y = pdf["value"].to_numpy(dtype=float)
        model, unit = pdf["model"].iloc[0], pdf["unit"].iloc[0]
        kv = [pdf[k].iloc[0] for k in eff]
        steps = {h: max(1, int(round(d / unit_days.get(unit, 1)))) for h, d in TS.HORIZONS}
        total = max(steps.values())
        if model == "ARIMA":
            preds = arima_predict(y, total)
        elif model in tables:
            n_lags = min(7, max(3, len(y) // 10))
            scale = float(np.mean(np.abs(y[n_lags:]))) or 1.0
            window = list(y / scale)
            preds = []
            for _ in range(total):
                x = [window[-k] if k <= n_lags else -1.0 for k in range(1, MAX_LAGS + 1)] + [float(n_lags)]
                p = _eval_trees(tables[model], np.asarray(x))
                preds.append(p * scale)
                window.append(p)
            preds = np.asarray(preds)
        else:
            preds = np.full(total, y[-1])
        last = pd.Timestamp(pdf["bucket"].iloc[-1])
        offset = {"W": pd.DateOffset(weeks=1), "MS": pd.DateOffset(months=1), "YS": pd.DateOffset(years=1)}.get(
            unit, pd.DateOffset(days=1))
        rows = []
        for h, s in steps.items():
            for i in range(1, s + 1):
                rows.append(kv + [model, h, i, last + offset * i, float(preds[i - 1])])
        return pd.DataFrame(rows, columns=names)

    out = joined.select(*eff, "bucket", "value", "unit", "model").groupBy(*eff).applyInPandas(run, schema)
    return out.drop("_all") if not keys else out


def forecast(df: DataFrame, date_col: str | None = None, value_col: str | None = None,
             keys: list[str] | None = None, frequency: str | None = None,
             models: list[str] | None = None, max_points: int | None = TS.MAX_POINTS) -> dict[str, DataFrame]:
    """the forecast bundle for every key: series, backtest, metrics, choice, points, status.

    ``max_points`` keeps the most recent buckets of each series (F5), None all. Only models that some key chose are fitted.
    """
    keys = keys or []
    models = models or TS.MODEL_ORDER
    work, dcol, vcol = TS.resolve_columns(df, date_col, value_col)
    ser = TS.time_series(work, dcol, vcol, keys, frequency)
    ser = stable(ser if max_points is None else TS.recent(ser, keys, max_points))
    bt = backtest(ser, keys, models)
    met = stable(TS.metrics(bt, keys))
    choice = TS.choose(met, keys)
    chosen = [r["model"] for r in choice.select("model").distinct().collect()]  # at most one row per candidate
    tables = final_models(ser, keys, [m for m in chosen if m in ML_MODELS])
    pts = forecast_points(ser, choice, keys, tables)
    return {"series": ser, "backtest": bt, "metrics": met, "choice": choice, "points": pts,
            "status": TS.series_status(work, dcol, vcol, keys)}
