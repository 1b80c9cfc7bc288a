"""Dashboard queries (D1-D16): KPIs, filter options, filters and chart data.

Each chart query is a plain aggregate / top-k / projection. Top-k reports
(``bar``, ``pie``) end in ``orderBy(...).limit(k)``, planned as TakeOrdered
after a partial + final aggregate, so only k rows per task travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (DATETIME_TYPES, NUMERIC_TYPES, as_text, col, datetime_typed_columns, num,
                                 numeric_columns)
from .profile import one_row, value_frequencies
from .roles import geo_columns

KPI_COLUMNS = 3
KPI_CAP = 8


def kpi_specs(df: DataFrame) -> list[tuple]:
    """Row count, and count, sum and mean of the first numeric columns, for one scan."""
    specs = [("_rows", F.count(F.lit(1)).cast("double"), 1)]
    for i, c in enumerate(numeric_columns(df)[:KPI_COLUMNS]):
        v = num(df, c)
        specs += [(f"_n{i}", F.count(v), 1), (f"_s{i}", F.sum(v), 1), (f"_a{i}", F.avg(v), 2)]
    return specs


def bound_specs(df: DataFrame, date_col: str | None = None) -> list[tuple]:
    """First and last date of a column (the first date column by default), for one scan; none without one."""
    date_col = date_col or next(iter(datetime_typed_columns(df)), None)
    if date_col is None:
        return []
    return [("_min_date", F.min(col(date_col)).cast("date"), 1), ("_max_date", F.max(col(date_col)).cast("date"), 1)]


def kpis(df: DataFrame, intent: str = "general_analysis", one: DataFrame | None = None) -> DataFrame:
    """(ord, id, label, value) — row count, sum and mean of the first three numerics
    (all-null ones skipped), and the margin for the ``profit_loss`` intent; at most 8 cards."""
    numeric = numeric_columns(df)
    first = numeric[:KPI_COLUMNS]
    specs = kpi_specs(df)
    margin = intent == "profit_loss" and len(numeric) >= 2
    if margin:
        specs.append(("_margin", F.sum(F.coalesce(num(df, numeric[0]), F.lit(0.0))) - F.sum(F.coalesce(num(df, numeric[1]), F.lit(0.0))), 2))
    agg = one_row(df, specs, None if margin else one)
    cards = [F.struct(F.lit(0).alias("k"), F.lit("row_count").alias("id"), F.lit("Row count").alias("label"),
                      F.col("_rows").alias("value"), F.lit(True).alias("_on"))]
    for i, c in enumerate(first):
        on = F.col(f"_n{i}") > 0
        cards.append(F.struct(F.lit(1 + 2 * i).alias("k"), F.lit(f"sum_{c}").alias("id"), F.lit(f"Total {c}").alias("label"),
                              F.col(f"_s{i}").alias("value"), on.alias("_on")))
        cards.append(F.struct(F.lit(2 + 2 * i).alias("k"), F.lit(f"mean_{c}").alias("id"), F.lit(f"Mean {c}").alias("label"),
                              F.col(f"_a{i}").alias("value"), on.alias("_on")))
    if margin:
        cards.append(F.struct(F.lit(100).alias("k"), F.lit("margin_proxy").alias("id"),
                              F.lit(f"Difference ({numeric[0]} - {numeric[1]})").alias("label"),
                              F.col("_margin").alias("value"), F.lit(True).alias("_on")))
    kept = F.filter(F.array(*cards), lambda s: s["_on"])
    rows = agg.select(F.posexplode(kept).alias("pos", "card"))
    return rows.select((F.col("pos") + 1).alias("ord"), "card.id", "card.label", "card.value").where(
        F.col("ord") <= KPI_CAP)


def margin_kpi(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """D3: one row (a, b, value) with sum(a) - sum(b), missing values counted as 0."""
    numeric = numeric_columns(df)
    a = a or numeric[0]
    b = b or numeric[1]
    return df.agg((F.sum(F.coalesce(num(df, a), F.lit(0.0))) - F.sum(F.coalesce(num(df, b), F.lit(0.0)))).alias("value")
                  ).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "value")


def filter_options(df: DataFrame, max_columns: int = 4, max_values: int = 50, freq: DataFrame | None = None) -> DataFrame:
    """(column_name, ord, value) — up to 50 distinct string values for the first four
    non-numeric columns, in value order (deterministic stand-in for first-seen order)."""
    cats = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)][:max_columns]
    if not cats:
        return df.sparkSession.createDataFrame([], "column_name string, ord int, value string")
    distinct = freq.where(F.col("column_name").isin(cats)) if freq is not None else value_frequencies(df, cats)
    w = Window.partitionBy("column_name").orderBy("value")
    return distinct.select("column_name", F.row_number().over(w).alias("ord"), "value").where(F.col("ord") <= max_values)


def date_bounds(df: DataFrame, date_col: str | None = None, one: DataFrame | None = None) -> DataFrame:
    """One row (column_name, min_date, max_date) for the first date column."""
    specs = bound_specs(df, date_col)
    if not specs:
        return df.sparkSession.createDataFrame([], "column_name string, min_date date, max_date date")
    name = date_col or datetime_typed_columns(df)[0]
    return one_row(df, specs, one).where(F.col("_min_date").isNotNull()).select(
        F.lit(name).alias("column_name"), F.col("_min_date").alias("min_date"), F.col("_max_date").alias("max_date"))


def apply_filters(df: DataFrame, members: dict[str, list[str]] | None = None,
                  date_range: tuple[str, str, str] | None = None) -> DataFrame:
    """D6 + D7: membership on the string form (empty selection = no filter, unknown columns
    skipped) and an inclusive date range on the raw column, so both reach the scan as pushed filters."""
    out = df
    for c, values in (members or {}).items():
        if c not in df.columns or not values:
            continue
        if isinstance(df.schema[c].dataType, T.StringType):
            out = out.where(col(c).isin(list(values)))
        else:
            out = out.where(as_text(df, c).isin(list(values)))
    if date_range is not None:
        c, start, end = date_range
        if c in df.columns:
            lo = F.lit(start).cast("date").cast(df.schema[c].dataType) if isinstance(
                df.schema[c].dataType, DATETIME_TYPES) else F.lit(start)
            hi = F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[c].dataType)
            out = out.where((col(c) >= lo) & (col(c) < hi))
    return out


def line_data(df: DataFrame, x: str, y: str, max_points: int | None = None) -> DataFrame:
    """(x, y) with missing dropped, ordered by x; above ``max_points`` the x-range is cut into
    equal buckets and y averaged per bucket."""
    pts = df.select(col(x).alias(x), num(df, y).alias(y)).na.drop()
    if max_points is None:
        return pts.orderBy(x, y)
    xs = F.col(x).cast("timestamp").cast("double") if isinstance(df.schema[x].dataType, DATETIME_TYPES) \
        else F.col(x).cast("double")
    bounds = pts.agg(F.min(xs).alias("_lo"), F.max(xs).alias("_hi"))
    b = F.least(F.floor((xs - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)) * max_points),
                F.lit(max_points - 1))
    return (pts.crossJoin(F.broadcast(bounds)).groupBy(b.alias("bucket"))
            .agg(F.min(F.col(x)).alias(x), F.avg(F.col(y)).alias(y)).orderBy("bucket").drop("bucket"))


def bar_data(df: DataFrame, x: str, y: str, k: int = 25) -> DataFrame:
    """Group sums (NULL group kept), largest first, top k."""
    return (df.groupBy(col(x).alias(x)).agg(F.sum(num(df, y)).alias(y))
            .orderBy(F.col(y).desc_nulls_last(), F.col(x).asc_nulls_last()).limit(k))


def pie_data(df: DataFrame, names: str, values: str, k: int = 8, by: str = "key") -> DataFrame:
    """Group sums, first k groups in key order (NULL last), or the largest k with ``by='value'``."""
    g = df.groupBy(col(names).alias(names)).agg(F.sum(num(df, values)).alias(values))
    order = [F.col(names).asc_nulls_last()] if by == "key" else [F.col(values).desc_nulls_last(), F.col(names).asc_nulls_last()]
    return g.orderBy(*order).limit(k)


def scatter_data(df: DataFrame, x: str, y: str, max_points: int | None = None, seed: int = 42) -> DataFrame:
    """(x, y) pairs; above ``max_points`` so many of them, each row with the same chance (a sampling operator).

    Pairs are counted and put in the order of a seeded hash; of the N rows in that order, those at positions
    floor(i * N / max_points) are taken, as in ``stats.seeded_sample``.
    """
    from .ordered import prefix_sum

    pts = df.select(num(df, x).alias(x), num(df, y).alias(y))
    if max_points is None:
        return pts
    n = df.count()
    if n <= max_points:
        return pts
    pair = [F.coalesce(c.cast("string"), F.lit("null")) for c in (F.col("x"), F.col("y"))]
    counts = (pts.toDF("x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), *pair))).withColumn("g", F.lit(0)))
    placed = prefix_sum(counts, ["g"], ["h"], "cnt", "start")

    def taken_before(p):
        return f"({p} * {max_points} + {n - 1}) DIV {n}"

    copies = F.expr(f"CAST({taken_before('(start + cnt)')} - {taken_before('start')} AS INT)")
    return placed.select("x", "y", copies.alias("copies")).where("copies > 0").select(
        "x", "y", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).drop("one").toDF(x, y)


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, count) — equal-width bins over [min, max], max folded into the last bin."""
    v = num(df, x)
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    bounds = vals.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counts = vals.crossJoin(F.broadcast(bounds)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    out = spine.join(counts, "bin", "left")
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select("bin", (F.col("_lo") + F.col("bin") * w).alias("lower"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("upper"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def preview(df: DataFrame, n: int = 100, max_columns: int = 20) -> DataFrame:
    """First 20 columns, first n rows in the order of the first column."""
    cols = df.columns[:max_columns]
    return df.select(*[col(c) for c in cols]).orderBy(*[col(c) for c in cols[:1]]).limit(n)


def map_points(df: DataFrame) -> DataFrame:
    """(lat, lon) pairs from columns named lat/latitude/enlem and lon/lng/longitude/boylam; none without both."""
    lat, lon = geo_columns(df)
    if lat is None or lon is None:
        return df.sparkSession.createDataFrame([], "lat double, lon double")
    return df.select(num(df, lat).alias("lat"), num(df, lon).alias("lon")).na.drop()


def map_grid(df: DataFrame, cell: float = 0.01) -> DataFrame:
    """(lat, lon, count): the points of ``map_points`` counted by grid cells of ``cell`` degrees, for maps of many points."""
    return map_points(df).groupBy((F.floor(F.col("lat") / cell) * cell).alias("lat"), (F.floor(F.col("lon") / cell) * cell).alias("lon")).agg(
        F.count(F.lit(1)).alias("count"))


# Charts shown where an advice table recommends none.
FALLBACK_CHARTS = ["line", "bar", "scatter", "heatmap"]


def chart_specs(df: DataFrame, advice: DataFrame | None = None, cap: int = 8) -> DataFrame:
    """(ord, chart, title, x, y, names, values) from chart advice, else the fallback set."""
    from .advice import chart_advice

    given = advice is not None
    advice = advice if given else chart_advice(df)
    rec = advice.where(F.col("advice") == "recommend")
    none = rec.agg((F.count(F.lit(1)) == 0).alias("_none"))
    own = chart_advice(df).where(F.col("chart").isin(FALLBACK_CHARTS) & (F.col("advice") == "recommend"))
    rec = rec.unionByName(own.crossJoin(F.broadcast(none)).where("_none").drop("_none")) if given else rec
    return rec.select("ord", "chart", "title", "x", "y", "names", "values").where(F.col("ord") <= cap)
