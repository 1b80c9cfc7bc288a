"""Cleaning plan and the approved cleaning steps.

Nothing changes a table unless ``apply_cleaning`` is called with the step
ids; steps always run in the fixed order drop-high-missing -> dedup ->
median -> mode -> winsorize, each on the previous step's output.

Medians and IQR fences are exact order statistics (``brackets``), known when
a step is planned and put into its projection as constants; modes are a
one-row frame joined as a broadcast, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (DATETIME_TYPES, NUMERIC_TYPES, as_text, col, is_missing, num,
                                 numeric_columns, q)
from ..session import saved
from .brackets import Sketch, interpolate, order_statistics, quantile_ranks
from .profile import iqr_fences, is_narrow, repeated_digests, row_digest

# Step identifiers (the public names of the steps).
DROP_HIGH_MISSING = "drop_high_missing_columns"
DROP_DUPLICATES = "drop_duplicates"
IMPUTE_MEDIAN = "impute_numeric_median"
IMPUTE_MODE = "impute_categorical_mode"
WINSORIZE = "winsorize_outliers"
SCALE = "scale_standard"
ONEHOT = "encode_onehot"
DATETIME_PARTS = "feature_datetime_parts"
APPLY_ORDER = [DROP_HIGH_MISSING, DROP_DUPLICATES, IMPUTE_MEDIAN, IMPUTE_MODE, WINSORIZE]
HIGH_MISSING = 0.6

# What each step computes, in the order of the plan.
_PLAN = [
    (1, DROP_HIGH_MISSING, f"Columns missing {HIGH_MISSING:.0%} or more", f"keeps the columns whose share of missing values is below {HIGH_MISSING}; an empty table keeps all"),
    (2, IMPUTE_MEDIAN, "Median into numeric gaps", "exact median of each numeric column in place of NULL and NaN; such columns become DOUBLE"),
    (3, IMPUTE_MODE, "Mode into other gaps", "most frequent value of each text, boolean and date column in place of NULL, the smallest of ties"),
    (4, DROP_DUPLICATES, "One row of each set of equal rows", "groups by all columns, NULLs equal"),
    (5, WINSORIZE, "Values beyond the IQR fences", "moves values below q1 - 1.5 IQR or above q3 + 1.5 IQR to the fence, after imputation; no row goes"),
    (6, SCALE, "Z-scores", "(x - mean) / sample standard deviation of each numeric column, NULL for a constant one"),
    (7, ONEHOT, "0/1 columns of text levels", "a column per value of each text column with at most 20 values"),
    (8, DATETIME_PARTS, "Parts of dates", "year, month and day of each date column beside it"),
]


def _signals(df: DataFrame, one: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: n_rows, missing_total, duplicate_rows, high-missing and all-null column lists."""
    from .profile import duplicate_rows, missing_specs, one_row

    total = sum((F.col(f"_m{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    high = F.array_compact(F.array(*[F.when(F.col(f"_m{i}") / F.greatest(F.col("_n"), F.lit(1)) >= HIGH_MISSING, F.lit(c)) for i, c in enumerate(df.columns)]))
    allnull = F.array_compact(F.array(*[F.when((F.col("_n") > 0) & (F.col(f"_m{i}") == F.col("_n")), F.lit(c)) for i, c in enumerate(df.columns)]))
    sig = one_row(df, missing_specs(df), one).select(F.col("_n").alias("n_rows"), total.cast("long").alias("missing_total"), high.alias("high_missing"),
                                                     allnull.alias("all_null_columns"))
    return sig.crossJoin(F.broadcast((duplicates if duplicates is not None else duplicate_rows(df)).select("duplicate_rows")))


def validation(df: DataFrame) -> DataFrame:
    """One row (empty_table, all_null_columns, missing_total, duplicate_rows)."""
    s = _signals(df)
    return s.select((F.col("n_rows") == 0).alias("empty_table"),
                    F.array_join("all_null_columns", ",").alias("all_null_columns"),
                    "missing_total", "duplicate_rows")


def plan(df: DataFrame, one: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """(ord, id, title, detail, safe_default, impact) rows whose condition holds; ``one`` (``missing_specs``) and
    ``duplicates`` if known already."""
    has_numeric = bool(numeric_columns(df))
    has_text = any(isinstance(f.dataType, T.StringType) for f in df.schema.fields)
    s = _signals(df, one, duplicates)
    conds = {
        DROP_HIGH_MISSING: F.col("missing_total") > 0,
        IMPUTE_MEDIAN: F.col("missing_total") > 0,
        IMPUTE_MODE: F.col("missing_total") > 0,
        DROP_DUPLICATES: F.col("duplicate_rows") > 0,
        WINSORIZE: F.lit(has_numeric),
        SCALE: F.lit(has_numeric),
        ONEHOT: F.lit(has_text),
        DATETIME_PARTS: F.lit(True),
    }
    impact = {
        DROP_HIGH_MISSING: F.array_join("high_missing", ","),
        DROP_DUPLICATES: F.col("duplicate_rows").cast("string"),
    }
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(t).alias("title"),
                              F.lit(d).alias("detail"), F.lit(False).alias("safe_default"),
                              impact.get(i, F.lit(None).cast("string")).alias("impact"), conds[i].alias("_on"))
                     for o, i, t, d in _PLAN])
    return s.select(F.inline(rows)).where("_on").drop("_on")


def drop_high_missing(df: DataFrame, threshold: float = HIGH_MISSING) -> DataFrame:
    """Keep columns whose missing share is below ``threshold``.

    The output schema depends on the data, so the per-column shares (one
    number per column) are fetched once. An empty table keeps its columns.
    """
    if not df.columns:
        return df
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    n = row["_n"]
    if not n:
        return df
    keep = [c for i, c in enumerate(df.columns) if (row[f"m{i}"] or 0) / n < threshold]
    return df.select(*[col(c) for c in keep])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """C4: exact duplicate rows removed (which copy survives does not matter: rows are equal; NaN equals NaN only).

    Wide rows: only the rows whose digest repeats are shuffled and compared whole; all others stay where they are, if
    the repeated digests are few enough for the planner to send them to every task.
    """
    if not df.columns or is_narrow(df):
        return df.dropDuplicates()
    _, repeated = repeated_digests(df)
    marked = df.select("*", *row_digest(df))
    again = marked.join(repeated, ["_h1", "_h2"], "left_semi").select(*[col(c) for c in df.columns]).dropDuplicates()
    alone = marked.join(repeated, ["_h1", "_h2"], "left_anti").select(*[col(c) for c in df.columns])
    return alone.unionByName(again)


def _one_row(df: DataFrame, names: list[str], long: DataFrame, value_col: str) -> DataFrame:
    """Pivot a (column_name, value) table into one row with a column per name."""
    return long.groupBy().agg(*[F.max(F.when(F.col("column_name") == c, F.col(value_col))).alias(f"_s{i}")
                                for i, c in enumerate(names)])


def _numeric_rules(df: DataFrame, median: bool, fences: bool) -> dict[str, tuple[float | None, tuple[float, float] | None]]:
    """By numeric column the median that fills its gaps and the fences that clip it, from three scans for both.

    Filling z gaps with the median m puts z copies of m into the sorted values. A rank of the filled column is then m,
    or the same rank of the values below m, or the rank less z of those above: the fences of the filled column come
    from the ranks of the original one, and nothing is filled and sorted again.
    """
    columns = numeric_columns(df)
    sketch = Sketch(df, columns)
    gaps = {c: sketch.rows - sketch.count[c] if median else 0 for c in columns}
    filled = {c: sketch.count[c] + gaps[c] if sketch.count[c] else 0 for c in columns}
    ranks = {}
    for c in columns:
        quarter = quantile_ranks(filled[c], [0.25, 0.75]) if fences else []
        ranks[c] = (quantile_ranks(sketch.count[c], [0.5]) if median else []) + quarter + [r - gaps[c] for r in quarter]
    found, _ = order_statistics(df, sketch, ranks)
    out = {}
    for c in columns:
        n, z, middle = sketch.count[c], gaps[c], None
        if median and n:
            low, high = (found[c, r] for r in (quantile_ranks(n, [0.5])[0], quantile_ranks(n, [0.5])[-1]))
            middle = interpolate(lambda r, c=c: found[c, r].value, n, 0.5)
            at = next((h for h in (low, high) if h.value == middle), None)
            below, equal = (at.below, at.equal) if at else (high.below, 0)

        def value_at(rank, c=c, z=z):
            if not z or rank < below:
                return found[c, rank].value
            return middle if rank < below + equal + z else found[c, rank - z].value

        clip = None
        if fences and n:
            q1, q3 = (interpolate(value_at, filled[c], p) for p in (0.25, 0.75))
            clip = iqr_fences({c: [q1, q3]})[c][2:]
        out[c] = (middle, clip)
    return out


def _apply_rules(df: DataFrame, rules: dict) -> DataFrame:
    """One projection; numeric columns come back as DOUBLE."""
    sel = []
    for f in df.schema.fields:
        if f.name not in rules:
            sel.append(col(f.name))
            continue
        middle, clip = rules[f.name]
        v = num(df, f.name) if middle is None else F.coalesce(num(df, f.name), F.lit(middle))
        if clip is not None:
            v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(clip[0])), F.lit(clip[1])))
        sel.append(v.alias(f.name))
    return df.select(*sel)


def impute_median(df: DataFrame) -> DataFrame:
    """Numeric NULL/NaN -> exact column median; numeric columns come back as DOUBLE."""
    return _apply_rules(df, _numeric_rules(df, True, False)) if numeric_columns(df) else df


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode): most frequent string form per column, ties -> smallest.

    ``min_by`` keeps one candidate per group in the aggregation buffer, so
    the mode needs no sort of all distinct values.
    """
    from .profile import value_frequencies

    freq = value_frequencies(df, columns)
    return freq.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("k"), F.col("value").alias("v"))).alias("mode"))


def impute_mode(df: DataFrame) -> DataFrame:
    """Non-numeric NULLs -> the column mode (ties -> smallest); all-null columns untouched."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)
            and isinstance(f.dataType, (T.StringType, T.BooleanType) + DATETIME_TYPES)]
    if not cols:
        return df
    stats = F.broadcast(_one_row(df, cols, column_modes(df, cols), "mode"))
    out = df.crossJoin(stats)
    sel = []
    for f in df.schema.fields:
        if f.name in cols:
            i = cols.index(f.name)
            sel.append(F.coalesce(col(f.name), F.col(f"_s{i}").cast(f.dataType)).alias(f.name))
        else:
            sel.append(col(f.name))
    return out.select(*sel)


def winsorize(df: DataFrame) -> DataFrame:
    """Clip numeric values to the IQR fences; NULLs stay NULL; result DOUBLE."""
    return _apply_rules(df, _numeric_rules(df, False, True)) if numeric_columns(df) else df


def standard_scale(df: DataFrame) -> DataFrame:
    """(x - mean) / sample std per numeric column; constant columns -> NULL."""
    cols = numeric_columns(df)
    if not cols:
        return df
    stats = df.agg(*[F.avg(num(df, c)).alias(f"_a{i}") for i, c in enumerate(cols)],
                   *[F.stddev_samp(num(df, c)).alias(f"_d{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(stats))
    sel = []
    for f in df.schema.fields:
        if f.name in cols:
            i = cols.index(f.name)
            sel.append(F.try_divide(num(df, f.name) - F.col(f"_a{i}"),
                                    F.when(F.col(f"_d{i}") != 0, F.col(f"_d{i}"))).alias(f.name))
        else:
            sel.append(col(f.name))
    return out.select(*sel)


def onehot_levels(df: DataFrame, columns: list[str] | None = None, max_levels: int = 20) -> DataFrame:
    """(column_name, value, level_rank): levels of text columns with <= max_levels distinct values."""
    from pyspark.sql import Window

    from .profile import value_frequencies

    columns = columns if columns is not None else [f.name for f in df.schema.fields
                                                   if isinstance(f.dataType, T.StringType)]
    freq = value_frequencies(df, columns)
    # distinct count per column is a partial aggregate; only low-cardinality
    # columns survive, so each window group below holds <= max_levels rows
    small = freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_levels)
    kept = freq.join(F.broadcast(small.select("column_name")), "column_name")
    return kept.select("column_name", "value",
                       F.row_number().over(Window.partitionBy("column_name").orderBy("value")).alias("level_rank"))


def onehot_columns(df: DataFrame, columns: list[str] | None = None, max_levels: int = 20) -> DataFrame:
    """(column_name, n_levels, encoded): the text columns with their number of levels; those above ``max_levels`` stay text."""
    from .roles import distinct_counts

    columns = columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    levels = F.coalesce("n_distinct", F.lit(0)).cast("long")
    return names.join(distinct_counts(df, columns), "column_name", "left").select("column_name", levels.alias("n_levels"), (levels <= max_levels).alias("encoded"))


def onehot(df: DataFrame, columns: list[str] | None = None, max_levels: int = 20) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level of each low-cardinality text column.

    The output schema depends on the levels, so they (at most ``max_levels``
    per column) are fetched once; the encoding itself is a projection.
    """
    levels = onehot_levels(df, columns, max_levels).orderBy("column_name", "level_rank").collect()
    by_col: dict[str, list[str]] = {}
    for r in levels:
        by_col.setdefault(r["column_name"], []).append(r["value"])
    sel = []
    for f in df.schema.fields:
        if f.name in by_col:
            for v in by_col[f.name]:
                sel.append(F.when(col(f.name).isNull(), F.lit(None).cast("int"))
                           .otherwise((col(f.name) == F.lit(v)).cast("int")).alias(f"{f.name}_{v}"))
        else:
            sel.append(col(f.name))
    return df.select(*sel)


def datetime_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``<col>_year``, ``<col>_month``, ``<col>_day`` for each date column."""
    columns = columns if columns is not None else [f.name for f in df.schema.fields
                                                   if isinstance(f.dataType, DATETIME_TYPES)]
    out = df
    for c in columns:
        out = (out.withColumn(f"{c}_year", F.year(col(c))).withColumn(f"{c}_month", F.month(col(c)))
               .withColumn(f"{c}_day", F.dayofmonth(col(c))))
    return out


_STEPS = {DROP_HIGH_MISSING: drop_high_missing, DROP_DUPLICATES: drop_duplicates}


def apply_cleaning(df: DataFrame, operations: list[str] | None = None,
                   apply: bool = True) -> tuple[DataFrame, list[str]]:
    """C11: run the approved steps in the fixed order; unknown ids are ignored.

    ``operations=None`` means the safe defaults, of which there are none, so
    the table comes back unchanged; so does ``apply=False``. Modes concern the
    columns that medians and fences don't, so the numeric steps share their scans.
    """
    if not apply:
        return df, []
    applied = [step for step in APPLY_ORDER if step in set(operations or [])]
    out = df
    for step in (DROP_HIGH_MISSING, DROP_DUPLICATES):
        if step in applied:
            out = _STEPS[step](out)
    if DROP_DUPLICATES in applied and len(applied) > applied.index(DROP_DUPLICATES) + 1:
        out = saved(out)  # the later steps scan it several times
    rules = {}
    if {IMPUTE_MEDIAN, WINSORIZE} & set(applied) and numeric_columns(out):
        rules = _numeric_rules(out, IMPUTE_MEDIAN in applied, WINSORIZE in applied)
    if IMPUTE_MODE in applied:
        out = impute_mode(out)
    return _apply_rules(out, rules), applied
