"""Statistics suite (T1-T15): moments, correlation matrices, OLS, Welch t,
one-way ANOVA, confidence intervals, trend, Shapiro-Wilk and ADF.

Test statistics come from aggregates (partial + final); p-values and
quantiles are applied to the aggregate rows by Arrow UDFs (``dist``).
Shapiro-Wilk needs the ordered values of one bounded sample (500) and runs
per column in ``applyInPandas``; ADF sums Gram matrices of blocks of points.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.aggregates import one_row_agg
from ..functions.columns import col, num, numeric_columns, q
from .brackets import column_quantiles
from .ordered import null_safe_join, prefix_sum, prefix_sums
from ..session import saved
from .profile import SUMMARY_PROBS, SUMMARY_SCHEMA, pearson, summary_rows, summary_specs

ALPHA = 0.05


def shape_specs(df: DataFrame, columns: list[str], means: dict[str, float]) -> list[tuple]:
    """Sums of the first four powers of the deviations from about the mean, for one scan."""
    specs = []
    for i, c in enumerate(columns):
        d = num(df, c) - F.lit(means[c])
        specs += [(f"d1_{i}", F.sum(d), 1), (f"d2_{i}", F.sum(d * d), 1), (f"d3_{i}", F.sum(d * d * d), 1), (f"d4_{i}", F.sum(d * d * d * d), 1)]
    return specs


def skew_and_kurtosis(n: int, sums: list[float]) -> tuple[float | None, float | None]:
    """Bias-adjusted skewness (from 3 values) and excess kurtosis (from 4); 0 for equal values."""
    if n < 3:
        return None, None
    mu, r2, r3, r4 = (s / n for s in sums)  # mu: what the shift left of the mean
    m2 = r2 - mu * mu
    m3 = r3 - 3 * mu * r2 + 2 * mu ** 3
    m4 = r4 - 4 * mu * r3 + 6 * mu * mu * r2 - 3 * mu ** 4
    if m2 <= 0 or math.isnan(m2):
        return 0.0, (0.0 if n >= 4 else None)
    skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5
    return skew, ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) if n >= 4 else None)


DESCRIPTIVE_SCHEMA = f"{SUMMARY_SCHEMA}, skew double, kurtosis double"


def descriptive_table(df: DataFrame, columns: list[str], quartiles: dict[str, list], row: dict) -> DataFrame:
    """T1 from the quartiles and the aggregates of ``summary_specs`` and ``shape_specs``."""
    shapes = [skew_and_kurtosis(row[f"n{i}"], [row[f"d{k}_{i}"] for k in range(1, 5)]) for i in range(len(columns))]
    return df.sparkSession.createDataFrame([(*r, *x) for r, x in zip(summary_rows(df, columns, quartiles, row), shapes)], DESCRIPTIVE_SCHEMA)


def descriptive_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric summary plus bias-adjusted skewness and excess kurtosis, in the summary's three scans."""
    columns = columns if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], DESCRIPTIVE_SCHEMA)
    quartiles, _, row = column_quantiles(df, columns, SUMMARY_PROBS,
                                         more=lambda s: summary_specs(df, columns) + shape_specs(df, columns, s.mean))
    return descriptive_table(df, columns, quartiles, row)


def covariance(df: DataFrame, columns: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """T5: (a, b, i, j, cov, n) sample covariance over pairwise-complete rows, one aggregate."""
    from .profile import pair_moments

    columns = columns if columns is not None else numeric_columns(df)
    out = pair_moments(df, columns, "cov").withColumnRenamed("value", "cov")
    return out.withColumn("cov", F.round("cov", digits)) if digits is not None else out


def _ranks(src: DataFrame, columns: list[str], gappy: list[int]) -> DataFrame:
    """(column_name, v, cnt, r, n; for each gappy column g: cnt{g}, r{g}, n{g}): average ranks of each distinct value.

    r is the rank among the column's n values, r{g} the rank among the n{g} of them whose row has a value in column g
    as well: the running count of all rows gives the first, those of the rows complete with g the others. Values are
    counted before the shuffle, and one range sort serves all columns and all their partners.
    """
    partners = [F.count(F.col(f"x{g}")).alias(f"cnt{g}") for g in gappy]
    tables = [src.where(F.col(f"x{i}").isNotNull()).groupBy(F.col(f"x{i}").alias("v")).agg(F.count(F.lit(1)).alias("cnt"), *partners)
              .select(F.lit(i).alias("column"), "*") for i in range(len(columns))]
    weights = ["cnt", *[f"cnt{g}" for g in gappy]]
    placed = prefix_sums(reduce(DataFrame.unionByName, tables), ["column"], ["v"], weights, [w.replace("cnt", "before") for w in weights],
                         [w.replace("cnt", "n") for w in weights], few_groups=True)
    ranks = [(F.col(w.replace("cnt", "before")) + (F.col(w) + 1) / 2.0).alias(w.replace("cnt", "r")) for w in weights]
    return placed.select("column", "v", *weights, *[w.replace("cnt", "n") for w in weights], *ranks)


def spearman(df: DataFrame, columns: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """T4: (a, b, i, j, r, n) Spearman matrix with average ranks over the rows where both columns have values.

    Each column is ranked once, for itself and against every column with missing values (``_ranks``), and joined back
    to the rows by its value; one aggregate then sums the products of all pairs. Means of ranks are known, and their
    squares are summed over distinct values. So shuffles grow with the number of columns, not of pairs, with missing
    values or without. Sums of columns^2 numbers come to the driver.
    """
    columns = columns if columns is not None else numeric_columns(df)
    spark, k = df.sparkSession, len(columns)
    schema = "a string, b string, i int, j int, r double, n long"
    if k < 2:
        return spark.createDataFrame([], schema)
    src = df.select(*[num(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    gaps = one_row_agg(src, [("rows", F.count(F.lit(1)), 1)] + [(f"x{i}", F.count(f"x{i}"), 1) for i in range(k)]).first()
    gappy = [i for i in range(k) if gaps[f"x{i}"] < gaps["rows"]]
    ranks = saved(_ranks(src, columns, gappy))  # in order of column: a scan of one column skips the others'
    names = ["", *map(str, gappy)]

    def off(name):
        return F.col(f"r{name}") - (F.col(f"n{name}") + 1) / 2.0

    spread = {r["column"]: r for r in ranks.groupBy("column").agg(
        *[F.max(f"n{g}").alias(f"n{g}") for g in names], *[F.sum(F.col(f"cnt{g}") * off(g) * off(g)).alias(f"s{g}") for g in names]).collect()}
    rows = src
    for i in range(k):
        own = ranks.where(F.col("column") == i).select(F.col("v").alias(f"v{i}"), *[off(g).alias(f"d{i}_{g}") for g in names if g != str(i)])
        rows = rows.join(own, F.col(f"x{i}") == F.col(f"v{i}"), "left").drop(f"v{i}")
    partner = {i: str(i) if i in gappy else "" for i in range(k)}
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    cross = one_row_agg(rows, [(f"c{i}_{j}", F.expr(f"sum(d{i}_{partner[j]} * d{j}_{partner[i]})"), 1) for i, j in pairs]).first()
    out = []
    for i, j in [(i, i) for i in range(k)] + pairs:
        one, other = spread.get(i), spread.get(j)
        if i == j:
            r, n = (1.0 if one and one["s"] > 0 else None), (one["n"] if one else 0)
        elif one is None or other is None:
            r, n = None, 0
        else:
            squares = math.sqrt(one[f"s{partner[j]}"]) * math.sqrt(other[f"s{partner[i]}"])
            n = one[f"n{partner[j]}"]
            r = max(-1.0, min(1.0, cross[f"c{i}_{j}"] / squares)) if squares > 0 else None
        out += [(columns[i], columns[j], i, j, r, n)] + ([(columns[j], columns[i], j, i, r, n)] if i != j else [])
    table = spark.createDataFrame(out, schema)
    return table.withColumn("r", F.round("r", digits)) if digits is not None else table


def correlation_analysis(df: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """T3-T5 bundle: Pearson, Spearman and covariance rounded to 4 places."""
    return {"pearson": pearson(df, columns, digits=4), "spearman": spearman(df, columns),
            "covariance": covariance(df, columns)}


_OLS_OUT = T.StructType([T.StructField("term", T.StringType()), T.StructField("ord", T.IntegerType()),
                         T.StructField("coefficient", T.DoubleType()), T.StructField("r2", T.DoubleType()),
                         T.StructField("n", T.LongType())])


def ols(df: DataFrame, target: str | None = None, features: list[str] | None = None,
        max_features: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Least squares with intercept over listwise-complete numeric rows.

    y = ``target`` if numeric, else the last numeric column; X = the first
    ``max_features`` other numerics. One aggregate collects means and the
    centred cross-products (``covar_samp``); the small normal-equation
    system (min-norm solution via ``pinv``) is solved per group in an Arrow
    map over those aggregate rows. Output (keys..., term, ord, coefficient, r2, n).
    """
    keys = keys or []
    numeric = [c for c in numeric_columns(df) if c not in keys]
    if len(numeric) < 2:
        raise ValueError("regression needs two numeric columns")
    y = target if target in numeric else numeric[-1]
    xs = features or [c for c in numeric if c != y][:max_features]
    cols = xs + [y]
    clean = df.select(*[col(k) for k in keys], *[num(df, c).alias(c) for c in cols]).na.drop(subset=cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_samp(q(cols[i]), q(cols[j])).alias(f"c{i}_{j}"))
    moments = clean.groupBy(*[col(k) for k in keys]).agg(*aggs) if keys else clean.agg(*aggs)
    k = len(xs)
    key_fields = [f for f in moments.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + _OLS_OUT.fields)

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                n = int(r["n"])
                if n == 0:
                    continue
                m = np.array([r[f"m{i}"] for i in range(k + 1)], dtype=float)
                c = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        v = r[f"c{i}_{j}"]
                        v = 0.0 if v is None or pd.isna(v) else float(v)
                        c[i, j] = c[j, i] = v
                sxx, sxy, syy = c[:k, :k], c[:k, k], c[k, k]
                beta = np.linalg.pinv(sxx) @ sxy if n > 1 else np.zeros(k)
                intercept = m[k] - float(beta @ m[:k])
                sst = syy * (n - 1)
                ssr = max(0.0, (syy - 2 * float(beta @ sxy) + float(beta @ sxx @ beta)) * (n - 1))
                r2 = 1.0 - ssr / (sst if sst != 0 else 1.0)
                kv = [r[kk] for kk in keys]
                rows.append(kv + ["intercept", 0, intercept, r2, n])
                for i, name in enumerate(xs):
                    rows.append(kv + [name, i + 1, float(beta[i]), r2, n])
            yield pd.DataFrame(rows, columns=keys + ["term", "ord", "coefficient", "r2", "n"])

    return moments.mapInPandas(solve, schema).withColumn("target", F.lit(y))


def welch_t(df: DataFrame, a: str | None = None, b: str | None = None, min_n: int = 6) -> DataFrame:
    """Welch t-test between two numeric columns (default: the first two), each > 5 values.

    (a, b, n_a, n_b, mean_a, mean_b, statistic, df, p_value, significant).
    """
    numeric = numeric_columns(df)
    if a is None or b is None:
        if len(numeric) < 2:
            raise ValueError("t-test needs two numeric columns")
        a, b = numeric[0], numeric[1]
    va, vb = num(df, a), num(df, b)
    m = df.agg(F.count(va).alias("n_a"), F.count(vb).alias("n_b"), F.avg(va).alias("mean_a"),
               F.avg(vb).alias("mean_b"), F.var_samp(va).alias("var_a"), F.var_samp(vb).alias("var_b"))
    se2 = F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.pow(F.col("var_a") / F.col("n_a"), 2) / (F.col("n_a") - 1)
                       + F.pow(F.col("var_b") / F.col("n_b"), 2) / (F.col("n_b") - 1))
    out = (m.where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
           .select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_a", "n_b", "mean_a", "mean_b",
                   t.alias("statistic"), dof.alias("df")))
    return out.withColumn("p_value", dist.t_pvalue(F.col("statistic"), F.col("df"))).withColumn(
        "significant", F.col("p_value") < ALPHA)


def anova_groups(df: DataFrame, group: str, value: str, min_group: int = 3) -> DataFrame:
    """Per-group moments for one-way ANOVA: (group, n, mean, ss) with n >= ``min_group``."""
    v = num(df, value)
    g = df.select(col(group).alias("grp"), v.alias("v")).na.drop()
    return (g.groupBy("grp").agg(F.count("v").alias("n"), F.avg("v").alias("mean"),
                                 (F.var_pop("v") * F.count("v")).alias("ss"))
            .where(F.col("n") >= min_group))


def anova(df: DataFrame, group: str | None = None, value: str | None = None, max_levels: int = 8) -> DataFrame:
    """One-way ANOVA of ``value`` by ``group`` (default: first categorical with <= 8 levels x first numeric).

    (group, value, k, n, statistic, df_between, df_within, p_value, significant).
    """
    from .roles import low_cardinality_columns

    numeric = numeric_columns(df)
    if value is None:
        value = numeric[0]
    if group is None:
        cands = low_cardinality_columns(df, max_levels).orderBy("ordinal").select("column_name").limit(1).collect()
        if not cands:
            raise ValueError("no categorical column with few levels")
        group = cands[0]["column_name"]
    gm = anova_groups(df, group, value)
    tot = gm.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                 (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"))
    ssb = gm.crossJoin(F.broadcast(tot.select("grand"))).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"))
    out = tot.crossJoin(ssb).where(F.col("k") >= 2)
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    stat = F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2)
    res = out.select(F.lit(group).alias("group"), F.lit(value).alias("value"), "k", "n", stat.alias("statistic"),
                     d1.alias("df_between"), d2.alias("df_within"))
    return res.withColumn("p_value", dist.f_pvalue(F.col("statistic"), F.col("df_between"), F.col("df_within"))
                          ).withColumn("significant", F.col("p_value") < ALPHA)


def confidence_intervals(df: DataFrame, confidence: float = 0.95, columns: list[str] | None = None,
                         keys: list[str] | None = None) -> DataFrame:
    """T-based interval of the mean per numeric column (n >= 3).

    (keys..., column_name, n, mean, sem, lower, upper, confidence).
    """
    from .quantiles import long_values

    keys = keys or []
    columns = columns if columns is not None else [c for c in numeric_columns(df) if c not in keys]
    lv = long_values(df, columns, keys)
    m = (lv.groupBy(*keys, "column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"),
                                               (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"))
         .where(F.col("n") >= 3))
    tq = dist.t_quantile(F.lit((1 + confidence) / 2.0), F.col("n") - 1)
    return (m.withColumn("_t", tq)
            .select(*keys, "column_name", "n", "mean", "sem", (F.col("mean") - F.col("_t") * F.col("sem")).alias("lower"),
                    (F.col("mean") + F.col("_t") * F.col("sem")).alias("upper"), F.lit(confidence).alias("confidence")))


MAX_TREND_POINTS = 5000


def _positions(df: DataFrame, date_col: str, value_col: str, keys: list[str]) -> DataFrame:
    """(keys..., d, y, cnt, start): runs of equal (date, value) with their first 0-based position.

    Equal (date, value) rows are interchangeable for a regression on
    position, so they are counted instead of ordered one by one.
    """
    src = df.select(*[col(k) for k in keys], col(date_col).alias("d"), num(df, value_col).alias("y")).na.drop(
        subset=["d", "y"])
    runs = src.groupBy(*keys, "d", "y").agg(F.count(F.lit(1)).alias("cnt"))
    return prefix_sum(runs, keys, ["d", "y"], "cnt", "start")


def trend(df: DataFrame, date_col: str, value_col: str, keys: list[str] | None = None, min_points: int = 10,
          positions: DataFrame | None = None) -> DataFrame:
    """Linear trend of value on position in date order over all points, per key.

    Positions 0..n-1 have a closed-form mean and spread, and a run of equal (date, value) rows its mean position, so no
    row is ordered individually. Sums are centred and in DOUBLE. (``downsampled_series`` thins a series where wanted.)
    ``positions``: the series' ``_positions`` if known already.
    (keys..., n, slope, intercept, r, statistic, p_value, direction).
    """
    keys = keys or []
    pos = positions if positions is not None else _positions(df, date_col, value_col, keys)
    sizes = pos.groupBy(*keys).agg(F.sum("cnt").cast("double").alias("nd"), F.try_divide(F.sum(F.col("cnt") * F.col("y")), F.sum("cnt")).alias("my"))
    j = pos.join(sizes, keys, "inner") if keys else pos.crossJoin(F.broadcast(sizes))
    cnt, dy = F.col("cnt").cast("double"), F.col("y") - F.col("my")
    dx = F.col("start").cast("double") + (cnt - 1) / 2 - (F.col("nd") - 1) / 2
    agg = j.groupBy(*keys, "nd", "my").agg(F.sum(cnt * dx * dy).alias("cxy"), F.sum(cnt * dy * dy).alias("cyy"))
    nd, cxx = F.col("nd"), F.col("nd") * (F.col("nd") * F.col("nd") - 1) / 12
    slope = F.try_divide(F.col("cxy"), cxx)
    r = F.when(F.col("cyy") > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.col("cxy"), F.sqrt(cxx) * F.sqrt("cyy")))))
    out = agg.where(nd >= min_points).select(*keys, nd.cast("long").alias("n"), slope.alias("slope"),
                                             (F.col("my") - slope * (nd - 1) / 2).alias("intercept"), r.alias("r"))
    tstat = F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    out = out.withColumn("statistic", tstat).withColumn(
        "p_value", F.when(F.abs(F.col("r")) >= 1.0, F.lit(0.0)).otherwise(dist.t_pvalue(F.col("statistic"), F.col("n") - 2)))
    return out.withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down")
                          .otherwise("flat"))


def downsampled_series(df: DataFrame, date_col: str, value_col: str, keys: list[str] | None = None,
                       max_points: int = MAX_TREND_POINTS) -> DataFrame:
    """(keys..., x, d, y) — the kept points of the date-ordered series (every step-th row)."""
    keys = keys or []
    pos = _positions(df, date_col, value_col, keys)
    sizes = pos.groupBy(*keys).agg(F.sum("cnt").alias("n_all"))
    step = F.when(F.col("n_all") > max_points, F.floor(F.col("n_all") / max_points)).otherwise(F.lit(1)).cast("long")
    j = (pos.join(sizes, keys, "inner") if keys else pos.crossJoin(F.broadcast(sizes))).withColumn("step", step)
    j = j.withColumn("j0", F.ceil(F.col("start") / F.col("step")).cast("long")).withColumn(
        "j1", F.floor((F.col("start") + F.col("cnt") - 1) / F.col("step")).cast("long"))
    return j.where(F.col("j1") >= F.col("j0")).select(
        *keys, F.explode(F.sequence("j0", "j1")).alias("x"), "d", "y")


# Royston (1995) polynomial coefficients of the Shapiro-Wilk approximation.
_SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_SW_C6 = [-0.4803, -0.082676, 0.0030302]
_SW_G = [-2.273, 0.459]


def _poly(c: list[float], x: float) -> float:
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value (Royston's approximation), 3 <= n <= 5000."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1.0 / math.sqrt(n)
    a = m / math.sqrt(mm)
    an = _poly(_SW_C1, u) + m[-1] / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    elif n > 5:
        an1 = _poly(_SW_C2, u) + m[-2] / math.sqrt(mm)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
        a = m / math.sqrt(phi)
        a[-1], a[0] = an, -an
    w = float((a @ x) ** 2 / np.sum((x - x.mean()) ** 2))
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    if n <= 11:
        gamma = _poly(_SW_G, n)
        mu = _poly(_SW_C3, n)
        sigma = math.exp(_poly(_SW_C4, n))
        y = -math.log(gamma - math.log1p(-w)) if w < 1 else float("inf")
    else:
        ln = math.log(n)
        mu = _poly(_SW_C5, ln)
        sigma = math.exp(_poly(_SW_C6, ln))
        y = math.log1p(-w) if w < 1 else float("-inf")
    z = (y - mu) / sigma
    return w, 1.0 - dist.norm_cdf(z)


SAMPLE_DIGITS = 4  # hexadecimal digits of the hash that make a bucket of the seeded order
SAMPLE_BUCKETS = 16 ** SAMPLE_DIGITS


def seeded_sample(df: DataFrame, columns: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """(column_name, v) - n non-missing values per column (all, if fewer), each row with the same chance.

    Values are counted and put in the order of a seeded hash; of the N rows in that order, those at positions
    floor(i * N / n) are taken. Equal rows are interchangeable, so the sample depends on the values alone, not on their
    partitions, and a value held by a third of the rows costs one row per map task. Only hash buckets that hold a taken
    position, at most n of a column's ``SAMPLE_BUCKETS``, are put in order; the others are just counted.
    """
    from .quantiles import long_values

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("column_name"), F.col("v").cast("string")))
    bucket = F.conv(F.substring(key, 1, SAMPLE_DIGITS), 16, 10).cast("int")
    counts = saved(long_values(df, columns).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt")).withColumn("bucket", bucket))
    column = Window.partitionBy("column_name")
    before = F.coalesce(F.sum("held").over(column.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = counts.groupBy("column_name", "bucket").agg(F.sum("cnt").alias("held")).select(
        "column_name", "bucket", "held", before.alias("below"), F.sum("held").over(column).alias("total"))

    def taken(start, cnt):
        def before(p):
            return f"CASE WHEN total <= {n} THEN {p} ELSE ({p} * {n} + total - 1) DIV total END"

        return F.expr(f"CAST({before(f'({start} + {cnt})')} - {before(start)} AS INT)")

    # at most n rows per column
    j = counts.join(F.broadcast(buckets.where(taken("below", "held") > 0).drop("held")), ["column_name", "bucket"]).withColumn("h", key)
    own = Window.partitionBy("column_name", "bucket").orderBy("h", "v").rowsBetween(Window.unboundedPreceding, -1)
    placed = j.withColumn("start", F.col("below") + F.coalesce(F.sum("cnt").over(own), F.lit(0)))
    copies = taken("start", "cnt")
    return placed.where(copies > 0).select("column_name", F.explode(F.array_repeat("v", copies)).alias("v"))


def normality(df: DataFrame, max_cols: int | None = None, sample: int = 500, seed: int = 42, min_n: int = 8) -> DataFrame:
    """Shapiro-Wilk on a seeded sample of <= 500 values for every numeric column (or the first ``max_cols``).

    (column_name, n, statistic, p_value, is_normal, skipped).
    """
    cols = numeric_columns(df)[:max_cols]
    counts = df.agg(*[F.count(num(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_all")) for i, c in enumerate(cols)])))
    smp = seeded_sample(df, cols, sample, seed)
    schema = "column_name string, n long, statistic double, p_value double"

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["v"].to_numpy()) if len(pdf) >= min_n else (float("nan"), float("nan"))
        return pd.DataFrame([[pdf["column_name"].iloc[0], len(pdf), w, p]],
                            columns=["column_name", "n", "statistic", "p_value"])

    res = smp.groupBy("column_name").applyInPandas(test, schema)
    out = counts.join(res, "column_name", "left")
    skipped = F.coalesce(F.col("n_all"), F.lit(0)) < min_n
    return out.select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      F.when(~skipped, F.col("statistic")).alias("statistic"),
                      F.when(~skipped, F.col("p_value")).alias("p_value"),
                      F.when(~skipped, F.col("p_value") >= ALPHA).alias("is_normal"), skipped.alias("skipped"))


# MacKinnon (1994) response-surface coefficients, constant-only case, one series.
_ADF_MAX, _ADF_MIN, _ADF_STAR = 2.74, -18.83, -1.61
_ADF_SMALLP = [2.1659, 1.4412, 0.038269]
_ADF_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]


def mackinnon_p(stat: float) -> float:
    if stat > _ADF_MAX:
        return 1.0
    if stat < _ADF_MIN:
        return 0.0
    coef = _ADF_SMALLP if stat <= _ADF_STAR else _ADF_LARGEP
    return dist.norm_cdf(_poly(coef, stat))


def adf_test(values: np.ndarray, maxlag: int | None = None) -> tuple[float, float, int, int]:
    """ADF t-statistic with a constant and a fixed lag (no automatic lag search)."""
    x = np.asarray(values, dtype=float)
    n = len(x)
    lag = maxlag if maxlag is not None else min(20, max(1, n // 20))
    dx = np.diff(x)
    nobs = len(dx) - lag
    if nobs <= lag + 3:
        return float("nan"), float("nan"), lag, max(nobs, 0)
    cols = [x[lag:-1]] + [dx[lag - i:len(dx) - i] for i in range(1, lag + 1)] + [np.ones(nobs)]
    X = np.column_stack(cols)
    yv = dx[lag:]
    beta, *_ = np.linalg.lstsq(X, yv, rcond=None)
    resid = yv - X @ beta
    dof = nobs - X.shape[1]
    sigma2 = float(resid @ resid) / dof
    cov = sigma2 * np.linalg.pinv(X.T @ X)
    se = math.sqrt(cov[0, 0]) if cov[0, 0] > 0 else float("nan")
    stat = float(beta[0] / se) if se and not math.isnan(se) else float("nan")
    return stat, mackinnon_p(stat) if not math.isnan(stat) else float("nan"), lag, nobs


ADF_BLOCK = 1 << 16  # consecutive points of one series that a task regresses at a time


def _lagged_gram(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, lag, i, j, v): Gram matrix of 1, the lagged differences, the level and the difference, in this order.

    runs: keys, start, cnt, x, n, lag, where a run is cnt points of the same x from position start. Runs go to every block
    of consecutive points they reach into, or into the lag + 1 points before it, and become points only there, so that a
    series of any length is regressed in parallel, however long its runs; the blocks' matrices are summed by Spark.
    """
    names = [*keys, "n", "lag", "i", "j", "v"]
    fields = [f for f in runs.schema.fields if f.name in keys]
    schema = T.StructType(sorted(fields, key=lambda f: keys.index(f.name)) + [
        T.StructField("n", T.LongType()), T.StructField("lag", T.IntegerType()), T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())])
    last = F.least(F.col("start") + F.col("cnt") + F.col("lag"), F.col("n") - 1)
    blocks = F.sequence(F.expr(f"start DIV {ADF_BLOCK}"), F.floor(last / ADF_BLOCK))
    dealt = runs.withColumn("block", F.explode(blocks))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        first = pdf.iloc[0]
        lag, at = int(first["lag"]), int(first["block"]) * ADF_BLOCK
        start = pdf["start"].to_numpy().clip(at - lag - 1, at + ADF_BLOCK)
        x = np.repeat(pdf["x"].to_numpy(float), (pdf["start"] + pdf["cnt"]).to_numpy().clip(at - lag - 1, at + ADF_BLOCK) - start)
        pos = np.arange(start[0], start[0] + len(x))
        at = np.flatnonzero((pos >= at) & (pos > lag))
        dx = np.diff(x, prepend=x[0])
        u = np.column_stack([np.ones(len(at)), *[dx[at - k] for k in range(1, lag + 1)], x[at - 1], dx[at]])
        m = u.T @ u
        i, j = np.indices(m.shape)
        out = pd.DataFrame({"n": first["n"], "lag": lag, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})
        for k in keys:
            out[k] = [first[k]] * len(out)
        return out[names]

    return dealt.groupBy(*keys, "block").applyInPandas(gram, schema).groupBy(*keys, "n", "lag", "i", "j").agg(F.sum("v").alias("v"))


def adf_from_gram(gram: np.ndarray, nobs: int) -> float:
    """ADF t-statistic of the level from the Gram matrix of (constant, lagged differences, level, difference)."""
    rest, last = gram[:-2, :-2], gram[:-2, -2:]
    left = gram[-2:, -2:] - last.T @ np.linalg.pinv(rest, hermitian=True) @ last  # level and difference less the others
    level, cross, square = left[0, 0], left[0, 1], left[1, 1]
    sigma2 = (square - cross * cross / level) / (nobs - (len(gram) - 1)) if level > 0 else float("nan")
    return float(cross / level / math.sqrt(sigma2 / level)) if sigma2 > 0 else float("nan")


def stationarity(df: DataFrame, date_col: str, value_col: str, keys: list[str] | None = None,
                 max_points: int | None = None, min_points: int = 10, max_lag: int | None = None,
                 positions: DataFrame | None = None) -> DataFrame:
    """ADF with a constant on all points of each date-ordered series, equal dates in order of value.

    The lag is min(20, max(1, n // 20)) or ``max_lag``; ``max_points`` thins long series first (``downsampled_series``).
    No series is gathered in one task. A series too short for its lag gets no statistic. ``positions``: the series'
    ``_positions`` if known already.
    (keys..., n, lag, statistic, p_value, is_stationary).
    """
    keys = keys or []
    eff = keys or ["_all"]
    if max_points:
        src = downsampled_series(df, date_col, value_col, keys, max_points).select(*keys, F.col("x").alias("start"), F.lit(1).cast("long").alias("cnt"), "y")
    else:
        src = positions if positions is not None else _positions(df, date_col, value_col, keys)
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    mean = F.try_divide(F.sum(F.col("cnt") * F.col("y")), F.sum("cnt"))
    sizes = src.groupBy(*eff).agg(F.sum("cnt").alias("n"), mean.alias("my")).where(F.col("n") >= min_points)
    lag = F.lit(max_lag) if max_lag is not None else F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.col("n") / 20)))
    runs = null_safe_join(src, sizes, eff, small_right=not keys).select(*eff, "start", "cnt", (F.col("y") - F.col("my")).alias("x"), "n", lag.cast("int").alias("lag"))
    gram = _lagged_gram(runs, eff)
    names = [*eff, "n", "lag", "statistic", "p_value"]
    schema = T.StructType([gram.schema[k] for k in eff] + [T.StructField("n", T.LongType()), T.StructField("lag", T.IntegerType()),
                                                           T.StructField("statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, lag, stat = int(first["n"]), int(first["lag"]), float("nan")
        if n - 1 - lag > lag + 3:
            m = np.zeros((lag + 3, lag + 3))
            m[pdf["i"], pdf["j"]] = pdf["v"]
            stat = adf_from_gram(m, n - 1 - lag)
        return pd.DataFrame([[*[first[k] for k in eff], n, lag, stat, float("nan") if math.isnan(stat) else mackinnon_p(stat)]], columns=names)

    res = gram.groupBy(*eff).applyInPandas(solve, schema)
    res = res.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("statistic", "p_value")})
    return res.drop("_all").withColumn("is_stationary", F.col("p_value") < ALPHA)


def statistics(df: DataFrame, target: str | None = None, date_col: str | None = None, shared=None) -> dict[str, DataFrame]:
    """The suite as a dict of tables, with the reference's input choices; ``shared`` (``plans.shared.Shared``) has
    what other sections of an analysis need as well."""
    from ..functions.columns import datetime_typed_columns
    from ..plans.shared import Shared
    from .roles import target_rank_map

    s = shared or Shared(df)
    out: dict[str, DataFrame] = {"descriptive": s.descriptive_stats(), "normality": normality(df)}
    numeric = numeric_columns(df)
    if len(numeric) >= 2:
        out["pearson"] = s.pairs("corr").withColumn("r", F.round("r", 4))
        out["spearman"] = spearman(df)
        out["covariance"] = s.pairs("cov").withColumn("cov", F.round("cov", 4))
        ranks = target_rank_map(df)
        tgt = target or (min(ranks, key=ranks.get) if ranks else None)
        out["regression"] = ols(df, tgt)
        out["t_test"] = welch_t(df)
    out["confidence_intervals"] = confidence_intervals(df)
    try:
        out["anova"] = anova(df)
    except ValueError:
        pass
    dcol = date_col or next(iter(datetime_typed_columns(df)), None)
    if dcol and numeric:
        positions = _positions(df, dcol, numeric[0], [])
        out["trend"] = trend(df, dcol, numeric[0], positions=positions)
        out["stationarity"] = stationarity(df, dcol, numeric[0], positions=positions)
    return out


# Order of the suite's sections in the report.
NOTE_SECTIONS = ["descriptive", "correlation", "regression", "t_test", "anova", "trend", "normality", "stationarity"]


def notes(results: dict[str, DataFrame]) -> DataFrame:
    """Plain-language lines from the suite's significance flags (section, line)."""
    parts = []
    if "t_test" in results:
        parts.append(results["t_test"].select(F.lit("t_test").alias("section"), F.when(
            F.col("significant"), F.format_string("Means of %s and %s may differ (p=%.4f).", "a", "b", "p_value"))
            .otherwise(F.format_string("No significant difference between %s and %s.", "a", "b")).alias("line")))
    if "anova" in results:
        parts.append(results["anova"].select(F.lit("anova").alias("section"), F.when(
            F.col("significant"), F.format_string("Mean %s differs across %s groups.", "value", "group"))
            .otherwise(F.format_string("No significant difference of mean %s across %s groups.", "value", "group"))
            .alias("line")))
    if "trend" in results:
        parts.append(results["trend"].select(F.lit("trend").alias("section"),
                                             F.format_string("Overall trend is %s.", "direction").alias("line")))
    if "regression" in results:
        parts.append(results["regression"].where("ord = 0").select(
            F.lit("regression").alias("section"),
            F.format_string("%s modelled on the selected features, R2=%.3f.", "target", "r2").alias("line")))
    if "descriptive" in results:
        parts.append(results["descriptive"].where(F.abs("skew") > 1).select(
            F.lit("descriptive").alias("section"), F.format_string("%s is skewed (%.2f).", "column_name", "skew").alias("line")))
    if "pearson" in results:
        parts.append(results["pearson"].where((F.col("i") < F.col("j")) & (F.abs("r") >= 0.7)).select(
            F.lit("correlation").alias("section"), F.format_string("%s and %s move together (r=%.2f).", "a", "b", "r").alias("line")))
    if "normality" in results:
        parts.append(results["normality"].where(~F.col("is_normal")).select(
            F.lit("normality").alias("section"), F.format_string("%s departs from a normal distribution.", "column_name").alias("line")))
    if "stationarity" in results:
        parts.append(results["stationarity"].select(F.lit("stationarity").alias("section"), F.when(
            F.col("is_stationary"), F.lit("The series looks stationary.")).otherwise(F.lit("The series may not be stationary.")).alias("line")))
    if not parts:
        raise ValueError("notes need at least one section of the suite")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
