"""Registered statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import stats as S
from . import fixtures as fx
from .catalog import LINEITEM_COLS, LINEITEM_NUM, T_, r6, register, rounded, sig, sig_sql, union_all
from .q_profile import _pair_sql, _summary_sql
from .sqlmath import eliminated, f_upper, norm_cdf, t_quantile_975, t_two_sided


@register("descriptive_stats", _summary_sql("lineitem", LINEITEM_NUM, LINEITEM_COLS, extra=True))
def q_descriptive_stats(spark, sf):
    return rounded(S.descriptive_stats(T_(spark, sf, "lineitem")))


@register("covariance_matrix", f"SELECT a, b, cov, n FROM ({_pair_sql('lineitem', LINEITEM_NUM, 'cov')})")
def q_covariance_matrix(spark, sf):
    return S.covariance(T_(spark, sf, "lineitem")).select("a", "b", "cov", "n")


def _spearman_sql(table: str, cols: list[str]) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY CAST({c} AS DOUBLE)) + (count(*) OVER (PARTITION BY CAST({c} AS DOUBLE)) - 1) / 2.0 AS {c}"
                      for c in cols)
    body = _pair_sql("rk", cols, "corr")
    return f"WITH rk AS (SELECT {ranks} FROM {table}) SELECT a, b, r, n FROM ({body})"


@register("spearman_matrix", _spearman_sql("lineitem", LINEITEM_NUM))
def q_spearman_matrix(spark, sf):
    return S.spearman(T_(spark, sf, "lineitem")).select("a", "b", "r", "n")


GAP_NUM = [*LINEITEM_NUM, "l_none"]


def _spearman_gaps_sql(table: str, cols: list[str]) -> str:
    """Ranks of each pair among the rows where both columns have values."""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) < max({a}) THEN 1.0::DOUBLE END AS r, count({a}) AS n FROM t")
                continue
            ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {x}" for c, x in ((a, "x"), (b, "y")))
            parts.append(f"SELECT '{a}', '{b}', CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 4) END, count(*) "
                         f"FROM (SELECT {ranks} FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return f"WITH t AS MATERIALIZED (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM {table}) {union_all(parts)}"


@register("spearman_gaps", _spearman_gaps_sql(fx.SQL["lineitem_gaps"] + " g0", GAP_NUM))
def q_spearman_gaps(spark, sf):
    """T4 with missing values: each pair is ranked over the rows where both have one."""
    return S.spearman(fx.lineitem_gaps(spark, sf)).select("a", "b", "r", "n")


@register("pearson_gaps", f"WITH g AS {fx.SQL['lineitem_gaps']} SELECT a, b, r, n FROM ({_pair_sql('g', GAP_NUM, 'corr')})")
def q_pearson_gaps(spark, sf):
    return P.pearson(fx.lineitem_gaps(spark, sf), digits=4).select("a", "b", "r", "n")


@register("covariance_gaps", f"WITH g AS {fx.SQL['lineitem_gaps']} SELECT a, b, cov, n FROM ({_pair_sql('g', GAP_NUM, 'cov')})")
def q_covariance_gaps(spark, sf):
    return S.covariance(fx.lineitem_gaps(spark, sf)).select("a", "b", "cov", "n")


BLEND_NUM = [*LINEITEM_NUM, "blend_above", "blend_below"]


@register("strong_pairs_rule", f"""
WITH g AS {fx.SQL['lineitem_blends']}, m AS ({_pair_sql('g', BLEND_NUM, 'corr', None)})
SELECT a, b, round(r, 4) AS r FROM m WHERE i < j AND abs(r) >= 0.7 ORDER BY abs(r) DESC, i, j LIMIT 20""")
def q_strong_pairs_rule(spark, sf):
    """P10 with its threshold, on a table with one pair a little above 0.7 and one a little below."""
    return P.strong_pairs(fx.lineitem_blends(spark, sf)).withColumn("r", F.round("r", 4))


@register("ols_single", """
SELECT 'intercept' AS term, 0 AS ord, round(regr_intercept(l_extendedprice, l_quantity), 6) AS coefficient,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem
UNION ALL
SELECT 'l_quantity', 1, round(regr_slope(l_extendedprice, l_quantity), 6), round(regr_r2(l_extendedprice, l_quantity), 6),
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) FROM lineitem""")
def q_ols_single(spark, sf):
    out = S.ols(T_(spark, sf, "lineitem"), target="l_extendedprice", features=["l_quantity"])
    return rounded(out.select("term", "ord", "coefficient", "r2", "n"))


OLS_X, OLS_Y = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"], "l_orderkey"
_OLS_CELLS = union_all([f"SELECT {i + 1} AS i, {j + 1} AS j, covar_samp({a}::DOUBLE, {b}::DOUBLE) AS v FROM lineitem"
                        for i, a in enumerate(OLS_X) for j, b in enumerate([*OLS_X, OLS_Y])])


@register("ols_regression", f"""
WITH RECURSIVE c AS MATERIALIZED ({_OLS_CELLS}),
g AS (SELECT 1 AS step, i, j, v FROM c UNION ALL
      SELECT a.step + 1, a.i, a.j, CASE WHEN a.i = a.step THEN a.v / p.v ELSE a.v - b.v * c.v / p.v END FROM g a
      JOIN g p ON p.i = a.step AND p.j = a.step JOIN g b ON b.i = a.i AND b.j = a.step JOIN g c ON c.i = a.step AND c.j = a.j WHERE a.step <= {len(OLS_X)}),
beta AS (SELECT i, v FROM g WHERE step = {len(OLS_X) + 1} AND j = {len(OLS_X) + 1}),
names AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{c}')" for i, c in enumerate(OLS_X))}) t(i, term)),
m AS (SELECT count(*) AS n, avg({OLS_Y}::DOUBLE) AS my, var_samp({OLS_Y}::DOUBLE) AS syy, [{', '.join(f'avg({c}::DOUBLE)' for c in OLS_X)}] AS mx FROM lineitem),
fit AS (SELECT (SELECT sum(beta.v * c.v) FROM beta JOIN c ON c.i = beta.i AND c.j = {len(OLS_X) + 1}) / syy AS r2,
               my - (SELECT sum(beta.v * m.mx[beta.i]) FROM beta) AS intercept, n FROM m),
rows AS (SELECT 'intercept' AS term, 0 AS ord, intercept AS coefficient FROM fit UNION ALL SELECT term, i, v FROM beta JOIN names USING (i))
SELECT term, ord, {sig_sql('coefficient', 7)} AS coefficient, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n, '{OLS_Y}' AS target FROM rows, fit""")
def q_ols_regression(spark, sf):
    """T6 by the reference's rule: y = first target candidate, X = first five other numerics."""
    out = S.ols(T_(spark, sf, "lineitem"), target=OLS_Y)
    return out.select("term", "ord", sig(F.col("coefficient"), 7).alias("coefficient"), F.round("r2", 6).alias("r2"), "n", "target")


_WELCH = """
WITH m AS (SELECT count(l_orderkey) AS n_a, count(l_partkey) AS n_b, avg(CAST(l_orderkey AS DOUBLE)) AS mean_a,
                  avg(CAST(l_partkey AS DOUBLE)) AS mean_b, var_samp(CAST(l_orderkey AS DOUBLE)) AS var_a,
                  var_samp(CAST(l_partkey AS DOUBLE)) AS var_b FROM lineitem)
SELECT 'l_orderkey' AS a, 'l_partkey' AS b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
       round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 6) AS statistic,
       round(power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)), 4) AS df
FROM m WHERE n_a >= 6 AND n_b >= 6"""


@register("welch_t", _WELCH)
def q_welch_t(spark, sf):
    out = S.welch_t(T_(spark, sf, "lineitem"))
    return out.select("a", "b", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "statistic")], F.round("df", 4).alias("df"))


_WELCH_P = t_two_sided("statistic", "df")


@register("welch_t_test", f"""
WITH m AS (SELECT count(l_orderkey) AS n_a, count(l_partkey) AS n_b, avg(CAST(l_orderkey AS DOUBLE)) AS mean_a, avg(CAST(l_partkey AS DOUBLE)) AS mean_b,
                  var_samp(CAST(l_orderkey AS DOUBLE)) AS var_a, var_samp(CAST(l_partkey AS DOUBLE)) AS var_b FROM lineitem),
t AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS statistic,
             power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS df FROM m WHERE n_a >= 6 AND n_b >= 6)
SELECT 'l_orderkey' AS a, 'l_partkey' AS b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(statistic, 6) AS statistic, round(df, 4) AS df, round({_WELCH_P}, 6) AS p_value, {_WELCH_P} < 0.05 AS significant FROM t""")
def q_welch_t_test(spark, sf):
    """Full T7 row with p-value and significance flag."""
    out = S.welch_t(T_(spark, sf, "lineitem")).withColumn("df", F.round("df", 4))
    return rounded(out)


@register("welch_t_close", f"""
WITH m AS (SELECT count(*) AS n_a, count(*) AS n_b, avg(l_discount) AS mean_a, avg(l_tax * 1.25::DOUBLE) AS mean_b, var_samp(l_discount) AS var_a, var_samp(l_tax * 1.25::DOUBLE) AS var_b FROM lineitem),
t AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS statistic,
             power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS df FROM m)
SELECT round(statistic, 6) AS statistic, round({_WELCH_P}, 6) AS p_value, {_WELCH_P} < 0.05 AS significant FROM t""")
def q_welch_t_close(spark, sf):
    """T7 for two columns whose means hardly differ, so that the tail is not zero."""
    li = T_(spark, sf, "lineitem").select("l_discount", (F.col("l_tax") * 1.25).alias("l_tax"))
    return rounded(S.welch_t(li, "l_discount", "l_tax").select("statistic", "p_value", "significant"))


_ANOVA = """
WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, avg(CAST(l_orderkey AS DOUBLE)) AS mean,
                  var_pop(CAST(l_orderkey AS DOUBLE)) * count(*) AS ss
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum(ss) AS ssw FROM g),
b AS (SELECT sum(g.n * power(g.mean - t.grand, 2)) AS ssb FROM g, t)
SELECT 'l_returnflag' AS "group", 'l_orderkey' AS value, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
       round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, CAST(k - 1 AS BIGINT) AS df_between,
       CAST(n - k AS BIGINT) AS df_within
FROM t, b WHERE k >= 2"""


@register("anova_f", _ANOVA)
def q_anova_f(spark, sf):
    out = S.anova(T_(spark, sf, "lineitem"))
    return rounded(out.select("group", "value", "k", "n", "statistic", "df_between", "df_within"))


_ANOVA_P = f_upper("statistic", "df_between", "df_within")


@register("anova_test", f"""
WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, avg(CAST(l_orderkey AS DOUBLE)) AS mean, var_pop(CAST(l_orderkey AS DOUBLE)) * count(*) AS ss
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum(ss) AS ssw FROM g),
b AS (SELECT sum(g.n * power(g.mean - t.grand, 2)) AS ssb FROM g, t),
f AS (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS statistic, k - 1 AS df_between, n - k AS df_within FROM t, b WHERE k >= 2)
SELECT 'l_returnflag' AS "group", 'l_orderkey' AS value, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(statistic, 6) AS statistic,
       CAST(df_between AS BIGINT) AS df_between, CAST(df_within AS BIGINT) AS df_within, round({_ANOVA_P}, 6) AS p_value, {_ANOVA_P} < 0.05 AS significant FROM f""")
def q_anova_test(spark, sf):
    """Full T8 row with the F-tail p-value."""
    return rounded(S.anova(T_(spark, sf, "lineitem")))


@register("mean_ci", union_all([
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, {r6(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
    f"{r6(f'stddev_samp(CAST({c} AS DOUBLE)) / sqrt(count({c}))')} AS sem FROM lineitem HAVING count({c}) >= 3"
    for c in LINEITEM_NUM]))
def q_mean_ci(spark, sf):
    return rounded(S.confidence_intervals(T_(spark, sf, "lineitem")).select("column_name", "n", "mean", "sem"))


@register("confidence_intervals", union_all([f"""
SELECT '{c}' AS column_name, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(mean - {t_quantile_975('n - 1')} * sem, 6) AS lower,
       round(mean + {t_quantile_975('n - 1')} * sem, 6) AS upper, 0.95::DOUBLE AS confidence
FROM (SELECT CAST(count({c}) AS BIGINT) AS n, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) / sqrt(count({c})) AS sem FROM lineitem) WHERE n >= 3"""
                                             for c in LINEITEM_NUM]))
def q_confidence_intervals(spark, sf):
    """Full T9 rows with t-quantile bounds."""
    return rounded(S.confidence_intervals(T_(spark, sf, "lineitem")))


_TREND = """
WITH s AS (SELECT o_orderdate AS d, CAST(o_totalprice AS DOUBLE) AS y FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
k AS (SELECT y, CAST(row_number() OVER (ORDER BY d, y) - 1 AS DOUBLE) AS x FROM s)
SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
       round(corr(y, x), 6) AS r, CASE WHEN regr_slope(y, x) > 0 THEN 'up' WHEN regr_slope(y, x) < 0 THEN 'down'
       ELSE 'flat' END AS direction
FROM k HAVING count(*) >= 10"""


@register("simple_trend", _TREND)
def q_simple_trend(spark, sf):
    out = S.trend(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r", 6).alias("r"), "direction")


_TREND_T = "r * sqrt(n - 2) / sqrt(greatest(1 - r * r, 0))"


@register("trend_test", f"""
WITH k AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS y,
                  CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_totalprice) - 1 AS DOUBLE) AS x
           FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
f AS (SELECT o_orderpriority, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r FROM k GROUP BY 1 HAVING count(*) >= 10),
t AS (SELECT *, {_TREND_T} AS statistic FROM f)
SELECT o_orderpriority, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(statistic, 6) AS statistic,
       round({t_two_sided('statistic', 'n - 2')}, 6) AS p_value, CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction FROM t""")
def q_trend_test(spark, sf):
    """T10 per order priority with t-statistic and p-value."""
    out = S.trend(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice", keys=["o_orderpriority"])
    return rounded(out.withColumn("intercept", F.round("intercept", 4)))


@register("shapiro")
def q_shapiro(spark, sf):
    return rounded(S.normality(T_(spark, sf, "lineitem")))


_ADF_P = f"""CASE WHEN statistic > 2.74 THEN 1 WHEN statistic < -18.83 THEN 0
  WHEN statistic <= -1.61 THEN {norm_cdf('(2.1659 + 1.4412 * statistic + 0.038269 * statistic * statistic)')}
  ELSE {norm_cdf('(1.7339 + 0.93202 * statistic - 0.12745 * statistic * statistic - 0.010368 * statistic * statistic * statistic)')} END"""


@register("adf", f"""
WITH RECURSIVE s AS (SELECT o_orderpriority AS k, o_orderdate AS d, o_totalprice::DOUBLE AS y, o_totalprice::DOUBLE - avg(o_totalprice::DOUBLE) OVER (PARTITION BY o_orderpriority) AS x,
                 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
e AS (SELECT *, least(20, greatest(1, n // 20)) AS lags, row_number() OVER w AS pos, lag(x) OVER w AS level, x - lag(x) OVER w AS dx FROM s WHERE n >= 10
      WINDOW w AS (PARTITION BY k ORDER BY d, y)),
u AS (SELECT k, n, lags, [1.0::DOUBLE] || [{', '.join(f'lag(dx, {i}) OVER w' for i in range(1, 21))}][1:lags] || [level, dx] AS u, pos FROM e
      WINDOW w AS (PARTITION BY k ORDER BY pos)),
c AS MATERIALIZED (SELECT k, n, lags, i, j, sum(u[i] * u[j]) AS v FROM (SELECT k, n, lags, u, i, unnest(range(1, lags + 4)) AS j
      FROM (SELECT *, unnest(range(1, lags + 4)) AS i FROM u WHERE pos > lags + 1)) GROUP BY ALL),
g AS ({eliminated('c', 'k', 'lags + 1')}),
l AS (SELECT k, max(CASE WHEN i = upto + 1 AND j = upto + 1 THEN v END) AS a, max(CASE WHEN i = upto + 1 AND j = upto + 2 THEN v END) AS b,
             max(CASE WHEN i = upto + 2 AND j = upto + 2 THEN v END) AS q FROM g WHERE step = upto + 1 GROUP BY k),
t AS (SELECT c.k, c.n, c.lags, (b / a) / sqrt((q - b * b / a) / ((c.n - 1 - c.lags) - (c.lags + 2)) / a) AS statistic FROM l JOIN (SELECT DISTINCT k, n, lags FROM c) c USING (k))
SELECT k AS o_orderpriority, CAST(n AS BIGINT) AS n, CAST(lags AS INTEGER) AS lag, round(statistic, 6) AS statistic, round({_ADF_P}, 6) AS p_value,
       {_ADF_P} < 0.05 AS is_stationary FROM t""")
def q_adf(spark, sf):
    return rounded(S.stationarity(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice", keys=["o_orderpriority"]))


@register("stat_notes")
def q_stat_notes(spark, sf):
    """T15 from all eight sections of the suite over lineitem."""
    li = T_(spark, sf, "lineitem")
    return S.notes(S.statistics(li, target="l_orderkey", date_col="l_shipdate"))


@register("seeded_sample", union_all([f"""SELECT '{c}' AS column_name, v FROM (
  SELECT v, row_number() OVER (ORDER BY md5('42|{c}|' || CAST(v AS VARCHAR)), v) - 1 AS p, count(*) OVER () AS total
  FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem) WHERE v IS NOT NULL)
WHERE total <= 500 OR p IN (SELECT (i * total) // 500 FROM range(500) r(i))""" for c in LINEITEM_NUM]))
def q_seeded_sample(spark, sf):
    """500 values per numeric column, placed by a seeded hash (a sampling operator)."""
    return S.seeded_sample(T_(spark, sf, "lineitem"), LINEITEM_NUM)
