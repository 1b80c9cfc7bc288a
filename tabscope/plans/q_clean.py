"""Registered cleaning queries (C1-C11) on the derived dirty events table."""

from __future__ import annotations

from ..operators import clean as C
from . import fixtures as fx
from .catalog import DIRTY_COLS, T_, r6, register, rounded, union_all

D = fx.SQL["events_dirty"]
NUM = ["event_id", "user_id", "value", "mostly_null"]


def _share(c: str) -> str:
    return f"CAST(count(*) - count({c}) AS DOUBLE) / greatest(count(*), 1)"


_SIGNALS = f"""
s AS (SELECT count(*) AS n_rows,
             CAST({' + '.join(f'(count(*) - count({c}))' for c in DIRTY_COLS)} AS BIGINT) AS missing_total,
             concat_ws(',', {', '.join(f"CASE WHEN {_share(c)} >= 0.6 THEN '{c}' END" for c in DIRTY_COLS)}) AS high,
             concat_ws(',', {', '.join(f"CASE WHEN count(*) > 0 AND count({c}) = 0 THEN '{c}' END" for c in DIRTY_COLS)}) AS allnull,
             CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicate_rows
      FROM d)"""


def _plan_rows() -> str:
    conds = {
        C.DROP_HIGH_MISSING: "missing_total > 0", C.IMPUTE_MEDIAN: "missing_total > 0",
        C.IMPUTE_MODE: "missing_total > 0", C.DROP_DUPLICATES: "duplicate_rows > 0",
        C.WINSORIZE: "TRUE", C.SCALE: "TRUE", C.ONEHOT: "TRUE", C.DATETIME_PARTS: "TRUE"}
    impact = {C.DROP_HIGH_MISSING: "high", C.DROP_DUPLICATES: "CAST(duplicate_rows AS VARCHAR)"}
    parts = []
    for o, i, t, dtl in C._PLAN:
        parts.append(f"SELECT CAST({o} AS INTEGER) AS ord, '{i}' AS id, '{t}' AS title, '{dtl}' AS detail, "
                     f"FALSE AS safe_default, {impact.get(i, 'CAST(NULL AS VARCHAR)')} AS impact FROM s "
                     f"WHERE {conds[i]}")
    return "\nUNION ALL\n".join(parts)


@register("cleaning_plan", f"WITH d AS {D}, {_SIGNALS}\n{_plan_rows()}")
def q_cleaning_plan(spark, sf):
    return C.plan(fx.events_dirty(spark, sf))


@register("cleaning_validation", f"""WITH d AS {D}, {_SIGNALS}
SELECT n_rows = 0 AS empty_table, allnull AS all_null_columns, missing_total, duplicate_rows FROM s""")
def q_cleaning_validation(spark, sf):
    return C.validation(fx.events_dirty(spark, sf))


@register("drop_high_missing", f"WITH d AS {D} SELECT event_id, ts, user_id, event_type, value FROM d")
def q_drop_high_missing(spark, sf):
    return C.drop_high_missing(fx.events_dirty(spark, sf))


@register("dedup", f"WITH d AS {D} SELECT DISTINCT * FROM d")
def q_dedup(spark, sf):
    return C.drop_duplicates(fx.events_dirty(spark, sf))


def _median_sql(src: str, num: list[str], cols: list[str]) -> str:
    meds = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in num)
    sel = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m.m_{c}) AS {c}" if c in num else c for c in cols)
    return f"SELECT {sel} FROM {src}, (SELECT {meds} FROM {src}) m"


def _mode_sql(src: str, cats: list[str], cols: list[str]) -> str:
    modes = ", ".join(
        f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM {src} WHERE {c} IS NOT NULL "
        f"GROUP BY 1 ORDER BY k DESC, v LIMIT 1)) AS md_{c}" for c in cats)
    sel = ", ".join(f"coalesce({c}, md.md_{c}) AS {c}" if c in cats else c for c in cols)
    return f"SELECT {sel} FROM {src}, (SELECT {modes}) md"


def _winsor_sql(src: str, num: list[str], cols: list[str]) -> str:
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}"
                   for c in num)
    sel = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), b.q1_{c} - 1.5 * (b.q3_{c} - b.q1_{c})), "
        f"b.q3_{c} + 1.5 * (b.q3_{c} - b.q1_{c})) END AS {c}" if c in num else c for c in cols)
    return f"SELECT {sel} FROM {src}, (SELECT {qs} FROM {src}) b"


def _round_sql(src: str, cols: list[str], dbl: list[str]) -> str:
    return "SELECT " + ", ".join(f"{r6(c)} AS {c}" if c in dbl else c for c in cols) + f" FROM {src}"


@register("median_impute", f"WITH d AS {D}, x AS ({_median_sql('d', NUM, DIRTY_COLS)}) "
          + _round_sql("x", DIRTY_COLS, NUM))
def q_median_impute(spark, sf):
    return rounded(C.impute_median(fx.events_dirty(spark, sf)))


@register("mode_impute", f"WITH d AS {D} " + _mode_sql("d", ["event_type"], DIRTY_COLS))
def q_mode_impute(spark, sf):
    return C.impute_mode(fx.events_dirty(spark, sf))


@register("winsorize", f"WITH d AS {D}, x AS ({_winsor_sql('d', NUM, DIRTY_COLS)}) " + _round_sql("x", DIRTY_COLS, NUM))
def q_winsorize(spark, sf):
    return rounded(C.winsorize(fx.events_dirty(spark, sf)))


@register("zscore", f"""WITH d AS {D}, st AS (SELECT {', '.join(f'avg(CAST({c} AS DOUBLE)) AS a_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}' for c in NUM)} FROM d)
SELECT {', '.join(f"{r6(f'(CAST({c} AS DOUBLE) - a_{c}) / CASE WHEN s_{c} <> 0 THEN s_{c} END')} AS {c}" if c in NUM else c for c in DIRTY_COLS)}
FROM d, st""")
def q_zscore(spark, sf):
    return rounded(C.standard_scale(fx.events_dirty(spark, sf)))


STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("onehot", "SELECT o_orderkey, o_custkey, "
          + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in STATUS)
          + ", o_totalprice, o_orderdate, "
          + ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in PRIORITY)
          + " FROM orders")
def q_onehot(spark, sf):
    return C.onehot(T_(spark, sf, "orders"))


@register("datetime_parts", "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, "
          "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
          "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day FROM orders")
def q_datetime_parts(spark, sf):
    return C.datetime_parts(T_(spark, sf, "orders"))


_KEEP = ["event_id", "ts", "user_id", "event_type", "value"]
_KNUM = ["event_id", "user_id", "value"]


@register("clean_pipeline", f"""WITH d AS {D},
d1 AS (SELECT {', '.join(_KEEP)} FROM d),
d2 AS (SELECT DISTINCT * FROM d1),
d3 AS ({_median_sql('d2', _KNUM, _KEEP)}),
d4 AS ({_mode_sql('d3', ['event_type'], _KEEP)}),
d5 AS ({_winsor_sql('d4', _KNUM, _KEEP)})
{_round_sql('d5', _KEEP, _KNUM)}""")
def q_clean_pipeline(spark, sf):
    out, _ = C.apply_cleaning(fx.events_dirty(spark, sf), [C.WINSORIZE, C.IMPUTE_MODE, C.IMPUTE_MEDIAN,
                                                           C.DROP_DUPLICATES, C.DROP_HIGH_MISSING])
    return rounded(out)


@register("onehot_columns", union_all([f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_levels, count(DISTINCT {c}) <= 20 AS encoded FROM part"
                                       for c in ("p_name", "p_brand", "p_type")]))
def q_onehot_columns(spark, sf):
    """Which text columns are encoded and which have too many levels."""
    return C.onehot_columns(T_(spark, sf, "part"))
