"""Time-series preparation for many series at once (F1-F8).

A series table is ``(keys..., bucket, value)`` with one row per regular
bucket. Per-key windows only ever run over bucketed series, whose length is
bounded by the time span divided by the frequency, not by the row count.
Frequency detection works on raw timestamps, so it uses the range-partitioned
``previous_value`` instead of a per-key window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, datetime_typed_columns, num, numeric_columns
from ..session import saved
from .ordered import null_safe_join, previous_value
from .profile import quantiles_from_ranked

# Median-gap thresholds (days) -> frequency label and unit.
FREQ_RULES = [(1.5, "daily", "D"), (8.0, "weekly", "W"), (35.0, "monthly", "MS"), (400.0, "yearly", "YS")]
MIN_POINTS = 12
MAX_POINTS = 3000
_DAY_US = 86400 * 1000000


def _gap_days(prev: Column, cur: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", prev, cur) / _DAY_US).cast("long")


def detect_frequency(df: DataFrame, date_col: str, keys: list[str] | None = None) -> DataFrame:
    """(keys..., n_dates, median_gap, frequency, unit) from gaps between distinct dates.

    Gaps are whole days (floored); the median is exact, taken from the gap
    histogram; fewer than 3 distinct dates -> ``unknown``.
    """
    keys = keys or []
    d = (df.select(*[col(k) for k in keys], col(date_col).alias("t")).where(F.col("t").isNotNull())
         .groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("_c")).drop("_c"))
    prev = previous_value(d, keys, "t", "prev")
    gaps = prev.where(F.col("prev").isNotNull()).select(*keys, _gap_days(F.col("prev"), F.col("t")).alias("g"))
    hist = gaps.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("cnt")).select(
        *keys, F.lit("gap").alias("column_name"), F.col("g").cast("double").alias("v"), "cnt")
    # the gap histogram holds one row per distinct whole-day gap of a key (bounded by the
    # key's span in days, not by its rows), so a per-key window ranks it
    part = [F.col(k) for k in keys] or [F.lit(0)]
    wr = Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("before", F.coalesce(F.sum("cnt").over(wr), F.lit(0)).cast("long"))
    med = quantiles_from_ranked(ranked, [0.5], keys).select(*keys, F.col("value").alias("median_gap"))
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"))
    out = counts.join(med, keys, "left") if keys else counts.crossJoin(F.broadcast(med))
    label, unit = F.lit("irregular"), F.lit("D")
    for limit, name, u in reversed(FREQ_RULES):
        label = F.when(F.col("median_gap") <= limit, F.lit(name)).otherwise(label)
        unit = F.when(F.col("median_gap") <= limit, F.lit(u)).otherwise(unit)
    few = F.col("n_dates") < 3
    return out.select(*keys, "n_dates", F.when(~few, F.col("median_gap")).alias("median_gap"),
                      F.when(few, F.lit("unknown")).otherwise(label).alias("frequency"),
                      F.when(few, F.lit("D")).otherwise(unit).alias("unit"))


def bucket_of(t: Column, unit: Column | str) -> Column:
    """Bucket label: day; week ending Sunday (label = that Sunday); month start; year start."""
    u = F.lit(unit) if isinstance(unit, str) else unit
    day = F.date_trunc("day", t)
    week = F.timestamp_add("DAY", F.lit(6), F.date_trunc("week", t))
    return (F.when(u == "W", week).when(u == "MS", F.date_trunc("month", t))
            .when(u == "YS", F.date_trunc("year", t)).otherwise(day))


def step_after(t: Column, unit: Column | str, steps: Column | int) -> Column:
    """t + steps units."""
    u = F.lit(unit) if isinstance(unit, str) else unit
    s = F.lit(steps) if isinstance(steps, int) else steps
    return (F.when(u == "W", F.timestamp_add("DAY", s * 7, t)).when(u == "MS", F.timestamp_add("MONTH", s, t))
            .when(u == "YS", F.timestamp_add("YEAR", s, t)).otherwise(F.timestamp_add("DAY", s, t)))


def _spine(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Every bucket from first to last per key."""
    u = F.col("unit")
    seq = (F.when(u == "W", F.sequence("first", "last", F.expr("INTERVAL 7 DAYS")))
           .when(u == "MS", F.sequence("first", "last", F.expr("INTERVAL 1 MONTH")))
           .when(u == "YS", F.sequence("first", "last", F.expr("INTERVAL 1 YEAR")))
           .otherwise(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))))
    return bounds.select(*keys, "unit", F.explode(seq).alias("bucket"))


def resolve_columns(df: DataFrame, date_col: str | None, value_col: str | None) -> tuple[DataFrame, str, str]:
    """F2 column choice: explicit -> derived revenue -> value-column rule; first date column."""
    from .roles import resolve_value_column, with_revenue

    work, revenue = with_revenue(df)
    dcol = date_col or next(iter(datetime_typed_columns(work)), None)
    if dcol is None:
        raise ValueError("no date column for a series")
    if value_col and value_col in work.columns:
        vcol = value_col
    elif revenue:
        vcol = revenue
    else:
        vcol = resolve_value_column(numeric_columns(work))
    if vcol is None:
        raise ValueError("no numeric value column for a series")
    return work, dcol, vcol


def time_series(df: DataFrame, date_col: str | None = None, value_col: str | None = None,
                keys: list[str] | None = None, frequency: str | None = None, fill: str = "zero",
                min_points: int = MIN_POINTS) -> DataFrame:
    """F2 + F3: (keys..., bucket, value, frequency, unit) — sums per regular bucket, gaps filled.

    ``frequency`` forces a unit (``D``, ``W``, ``MS``, ``YS``) for every key;
    otherwise it is detected per key. Empty buckets become 0 (``fill='zero'``,
    the sum of nothing) or NULL (``fill='null'``, for ``interpolate``). Keys
    with fewer than ``min_points`` raw rows or buckets are left out (see
    ``series_status``).
    """
    keys = keys or []
    work, dcol, vcol = resolve_columns(df, date_col, value_col)
    raw = work.select(*[col(k) for k in keys], col(dcol).alias("t"), num(work, vcol).alias("v")).na.drop(
        subset=["t", "v"])
    # the input is read once: every branch below reads its sums by key and timestamp
    per_t = saved(raw.groupBy(*keys, "t").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("_c")))
    sizes = per_t.groupBy(*keys).agg(F.sum("_c").alias("n_raw"))
    if frequency:
        labels = {u: name for _, name, u in FREQ_RULES}
        freq = sizes.select(*keys, "n_raw", F.lit(labels.get(frequency, "daily")).alias("frequency"),
                            F.lit(frequency).alias("unit"))
    else:
        det = detect_frequency(per_t, "t", keys).select(*keys, "frequency", "unit")
        freq = sizes.join(det, keys) if keys else sizes.crossJoin(F.broadcast(det))
    raw = per_t
    freq = freq.where(F.col("n_raw") >= min_points)
    tagged = raw.join(freq.select(*keys, "unit"), keys) if keys else raw.crossJoin(F.broadcast(freq.select("unit")))
    sums = tagged.groupBy(*keys, "unit", bucket_of(F.col("t"), F.col("unit")).alias("bucket")).agg(
        F.sum("v").alias("value"))
    bounds = sums.groupBy(*keys, "unit").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    spine = _spine(bounds, keys)
    filled = spine.join(sums, keys + ["unit", "bucket"], "left")
    value = F.coalesce(F.col("value"), F.lit(0.0)) if fill == "zero" else F.col("value")
    out = filled.select(*keys, "bucket", value.alias("value"), "unit")
    sizes2 = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_buckets")).where(F.col("n_buckets") >= min_points)
    out = out.join(sizes2, keys) if keys else out.crossJoin(F.broadcast(sizes2))
    labels = freq.select(*keys, "frequency")
    out = out.join(labels, keys) if keys else out.crossJoin(F.broadcast(labels))
    return out.select(*keys, "bucket", "value", "frequency", "unit")


def series_status(df: DataFrame, date_col: str, value_col: str, keys: list[str] | None = None,
                  min_points: int = MIN_POINTS) -> DataFrame:
    """(keys..., n_raw, available, reason) - which keys can be forecast and why not.

    A key needs ``min_points`` raw rows and as many buckets of its detected frequency between its first and last date.
    """
    keys = keys or []
    raw = df.select(*[col(k) for k in keys], col(date_col).alias("t"), num(df, value_col).alias("v")).na.drop(
        subset=["t", "v"])
    sizes = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    unit = detect_frequency(raw, "t", keys).select(*keys, "unit")
    j = sizes.join(unit, keys, "left") if keys else sizes.crossJoin(F.broadcast(unit))
    a, b, u = bucket_of(F.col("t0"), F.col("unit")), bucket_of(F.col("t1"), F.col("unit")), F.col("unit")
    days, months = F.datediff(b, a), F.timestamp_diff("MONTH", a, b)
    n_buckets = F.when(u == "W", days / 7).when(u == "MS", months).when(u == "YS", months / 12).otherwise(days) + 1
    few_rows, few_buckets = F.col("n_raw") < min_points, F.coalesce(n_buckets, F.lit(0)) < min_points
    reason = F.when(few_rows, F.lit(f"fewer than {min_points} points")).when(few_buckets, F.lit(f"fewer than {min_points} buckets"))
    return j.select(*keys, "n_raw", (~few_rows & ~few_buckets).alias("available"), reason.alias("reason"))


BLOCK = 1 << 16  # consecutive buckets of one series that a window sees at a time


def _position(first: Column, bucket: Column, unit: Column) -> Column:
    """Number of units from one bucket of a regular series to another."""
    days, months = F.datediff(bucket, first), F.round(F.months_between(bucket, first))
    return F.when(unit == "W", F.floor(days / 7)).when(unit == "MS", months).when(unit == "YS", F.round(months / 12)).otherwise(days).cast("long")


def _by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on the keys, null keys equal; without keys the right side has one row."""
    return null_safe_join(left, right, keys) if keys else left.crossJoin(F.broadcast(right))


def with_index(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """0-based position ``idx`` and length ``n`` of each bucket of a regular series (as ``time_series`` makes it), per key.

    Buckets are a unit apart, so that a position follows from the series' first bucket and no series is put in order.
    """
    keys = keys or []
    ends = series.groupBy(*keys).agg(F.min("bucket").alias("_first"), F.count(F.lit(1)).alias("n"))
    return _by_key(series, ends, keys).withColumn("idx", _position(F.col("_first"), F.col("bucket"), F.col("unit"))).drop("_first")


def _blocks(indexed: DataFrame, halo: int) -> DataFrame:
    """Rows with ``_b``, their block of BLOCK positions; the last ``halo`` rows of a block are also the next one's."""
    block = F.floor(F.col("idx") / BLOCK)
    ahead = F.when((F.col("idx") % BLOCK >= BLOCK - halo) & ((block + 1) * BLOCK < F.col("n")), block + 1)
    return indexed.withColumn("_b", F.explode(F.array_compact(F.array(block, ahead))))


def interpolate(series: DataFrame, keys: list[str] | None = None, value_col: str = "value") -> DataFrame:
    """linear interpolation by position between known neighbours; edges take the nearest value.

    Windows run over blocks of a series; the known values nearest to a block, before and after it, are carried over from
    a table of one row per block.
    """
    keys = keys or []
    s = _blocks(with_index(series, keys), 0)
    point = F.when(F.col(value_col).isNotNull(), F.struct(F.col("idx").alias("i"), F.col(value_col).alias("v")))
    ends = s.groupBy(*keys, "_b").agg(F.max(point).alias("_last"), F.min(point).alias("_next"))
    whole = Window.partitionBy(*keys, F.lit(0)).orderBy("_b")
    carry = ends.select(*keys, "_b", F.last("_last", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                        F.first("_next", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    part = Window.partitionBy(*keys, "_b").orderBy("idx")
    j = null_safe_join(s, carry, [*keys, "_b"])
    j = (j.withColumn("_p", F.coalesce(F.last(point, ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
         .withColumn("_q", F.coalesce(F.first(point, ignorenulls=True).over(part.rowsBetween(0, Window.unboundedFollowing)), "_after")))
    lin = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("idx") - F.col("_p.i")) / (F.col("_q.i") - F.col("_p.i"))
    v = (F.when(F.col(value_col).isNotNull(), F.col(value_col))
         .when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), lin)
         .otherwise(F.coalesce(F.col("_p.v"), F.col("_q.v"))))
    return j.withColumn(value_col, v).select(*series.columns)


def recent(series: DataFrame, keys: list[str] | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """keep the most recent ``max_points`` buckets per key."""
    return with_index(series, keys).where(F.col("idx") >= F.col("n") - max_points).select(*series.columns)


def lag_count(n: Column) -> Column:
    """L = min(7, max(3, n // 10))."""
    return F.least(F.lit(7), F.greatest(F.lit(3), F.floor(n / 10))).cast("int")


def lag_features(series: DataFrame, keys: list[str] | None = None, max_lags: int = 7) -> DataFrame:
    """(keys..., bucket, idx, n, n_lags, value, lag_1..lag_7) for rows idx >= n_lags.

    Each key uses L = min(7, max(3, n // 10)) lags; lag_k with k > L is NULL.
    """
    keys = keys or []
    s = _blocks(with_index(series, keys).withColumn("n_lags", lag_count(F.col("n"))), max_lags)
    w = Window.partitionBy(*keys, "_b").orderBy("idx")
    lags = [F.when(F.lit(k) <= F.col("n_lags"), F.lag("value", k).over(w)).alias(f"lag_{k}") for k in range(1, max_lags + 1)]
    return s.select("*", *lags).where((F.floor(F.col("idx") / BLOCK) == F.col("_b")) & (F.col("idx") >= F.col("n_lags"))).drop("_b")


def folds(lengths: DataFrame, keys: list[str] | None = None, n_col: str = "n", offset_col: str | None = None,
          count_col: str | None = None) -> DataFrame:
    """expanding splits, k = min(3, max(2, n // 10)), test size = n // (k + 1).

    (keys..., fold, test_start, test_end) in the key's own positions
    (shifted by ``offset_col`` when the split is over lag rows). ``count_col``
    is the length that decides the number of folds where it is not ``n_col``.
    """
    keys = keys or []
    n = F.col(n_col)
    k = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col(count_col or n_col) / 10))).cast("int")
    size = F.floor(n / (k + 1)).cast("long")
    base = lengths.select(*keys, n.alias("_n"), k.alias("n_folds"), size.alias("test_size"),
                          (F.col(offset_col) if offset_col else F.lit(0)).cast("long").alias("_off"))
    out = base.select(*keys, "_n", "n_folds", "test_size", "_off", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)).alias("fold"))
    start = F.col("_n") - (F.col("n_folds") - F.col("fold")) * F.col("test_size") + F.col("_off")
    return out.select(*keys, "fold", "n_folds", "test_size", start.alias("test_start"),
                      (start + F.col("test_size")).alias("test_end")).where(F.col("test_size") > 0)


def naive_backtest(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F8: last value before each fold's test window, carried over the window.

    Folds and the values before them are a row per key and fold, joined to the rows of the windows.
    (keys..., model, fold, bucket, y, yhat).
    """
    keys = keys or []
    s = with_index(series, keys)
    k = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("n") / 10))).cast("long")
    size = F.floor(F.col("n") / (k + 1)).cast("long")
    first = F.col("n") - k * size

    def fold_of(idx):
        return F.floor((idx - first) / size).cast("int")

    held = s.where(size > 0)
    inside = held.where(F.col("idx") >= first).withColumn("fold", fold_of(F.col("idx")))
    follows = (F.col("idx") + 1 >= first) & (F.col("idx") + 1 < F.col("n")) & (F.pmod(F.col("idx") + 1 - first, size) == 0)
    anchors = held.where(follows).select(*keys, fold_of(F.col("idx") + 1).alias("fold"), F.col("value").alias("yhat"))
    return null_safe_join(inside, anchors, [*keys, "fold"]).select(*keys, F.lit("NaiveLast").alias("model"), "fold", "bucket", F.col("value").alias("y"), "yhat")


def metrics(backtest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., model, n, mae, mse, rmse, mape, smape, r2) over all folds' test points."""
    keys = keys or []
    e = F.col("y") - F.col("yhat")
    agg = backtest.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-8))).alias("_mape"),
        F.avg(F.abs(e) / F.greatest((F.abs("y") + F.abs("yhat")) / 2.0, F.lit(1e-8))).alias("_smape"),
        F.sum(e * e).alias("_sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).when(F.col("_sse") == 0, F.lit(1.0)).otherwise(
        F.lit(0.0))
    return agg.select(*keys, "model", "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      (F.col("_mape") * 100).alias("mape"), (F.col("_smape") * 100).alias("smape"), r2.alias("r2"))


# Candidate order used to break RMSE ties.
MODEL_ORDER = ["NaiveLast", "ARIMA", "RandomForest", "XGBoost", "LightGBM"]


def choose(metric_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F16: (keys..., model, rmse) — lowest RMSE per key, ties by candidate order."""
    keys = keys or []
    order = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model")), F.lit(99))
    agg = metric_rows.where(F.col("rmse").isNotNull()).groupBy(*keys).agg(
        F.min_by("model", F.struct(F.col("rmse"), order)).alias("model"), F.min("rmse").alias("rmse"))
    return agg


# Horizon labels and their length in days.
HORIZONS = [("1w", 7), ("1m", 30), ("3m", 90), ("6m", 180), ("1y", 365)]
UNIT_DAYS = {"D": 1, "W": 7, "MS": 30, "YS": 365}


def horizon_steps(freq: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., horizon, days, steps) with steps = max(1, round-half-even(days / unit days))."""
    keys = keys or []
    unit_days = (F.when(F.col("unit") == "W", 7).when(F.col("unit") == "MS", 30).when(F.col("unit") == "YS", 365)
                 .otherwise(1))
    hz = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("days"), F.lit(i).alias("h_ord"))
                   for i, (h, d) in enumerate(HORIZONS)])
    return freq.select(*keys, "unit", F.inline(hz)).withColumn(
        "steps", F.greatest(F.lit(1), F.bround(F.col("days") / unit_days, 0)).cast("int"))


def naive_forecast(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F17/F20 for the NaiveLast model: the last value carried forward on future buckets.

    (keys..., horizon, step, bucket, value).
    """
    keys = keys or []
    last = series.groupBy(*keys).agg(F.max_by("value", "bucket").alias("last_value"), F.max("bucket").alias("last"),
                                     F.first("unit").alias("unit"))
    hs = horizon_steps(last, keys)
    pts = hs.select(*keys, "horizon", "h_ord", "unit", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("step"))
    j = pts.join(last.drop("unit"), keys) if keys else pts.crossJoin(F.broadcast(last.drop("unit")))
    return j.select(*keys, "horizon", "step", step_after(F.col("last"), F.col("unit"), F.col("step")).alias("bucket"),
                    F.col("last_value").alias("value"))
