"""Column profiling (P1-P11): shape, types, missing values, duplicates,
numeric summaries, value frequencies, IQR outliers and correlations.

Every function is lazy and returns a long-format DataFrame. Wide statistics
come from one aggregate over all columns (partial + final), value frequencies
from one unpivot + ``groupBy(column, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (ATOMIC_TYPES, FLOAT_TYPES, as_text, col, is_missing, kind_of,
                                 numeric_columns, categorical_columns, num)
from ..session import saved
from .brackets import column_quantiles
from .quantiles import pick_quantiles, ranked_counts

SUMMARY_PROBS = [0.25, 0.5, 0.75]


def missing_specs(df: DataFrame) -> list[tuple]:
    """Row count and missing values of each column, for one scan."""
    return [("_n", F.count(F.lit(1)), 1)] + [(f"_m{i}", F.count(F.when(is_missing(df, c), 1)), 1) for i, c in enumerate(df.columns)]


def volume_specs(df: DataFrame) -> list[tuple]:
    """Bytes of each column, for one scan."""
    specs = []
    for i, f in enumerate(df.schema.fields):
        width = next((w for t, w in _WIDTHS.items() if isinstance(f.dataType, t)), 16 if isinstance(f.dataType, T.DecimalType) else None)
        bytes_ = F.count(F.lit(1)) * width if width is not None else F.coalesce(F.sum(F.octet_length(col(f.name).cast("string"))), F.lit(0))
        specs.append((f"_b{i}", bytes_.cast("long"), 1))
    return specs


def one_row(df: DataFrame, specs: list[tuple], one: DataFrame | None = None) -> DataFrame:
    """The one-row aggregate of ``specs``, or ``one`` where another pass has computed them already."""
    from ..functions.aggregates import one_row_agg

    return one if one is not None else one_row_agg(df, specs)


def overview(df: DataFrame, one: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: n_rows, n_columns, missing_cells, duplicate_rows; ``one`` and ``duplicates`` if known already."""
    base = one_row(df, missing_specs(df), one)
    cells = sum((F.col(f"_m{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    dup = (duplicates if duplicates is not None else duplicate_rows(df)).select("duplicate_rows")
    return base.crossJoin(F.broadcast(dup)).select(F.col("_n").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                                                   cells.alias("missing_cells"), "duplicate_rows")


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, dtype, kind)."""
    return df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column_name string, ordinal int, dtype string, kind string")


def missing(df: DataFrame, one: DataFrame | None = None) -> DataFrame:
    """(column_name, ordinal, n_missing, pct_missing) — pct = missing / max(rows, 1) * 100, 2 places."""
    if not df.columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, ordinal int, n_missing long, pct_missing double")
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), F.col(f"_m{i}").alias("n_missing"))
                     for i, c in enumerate(df.columns)])
    return one_row(df, missing_specs(df), one).select("_n", F.inline(rows)).select(
        "column_name", "ordinal", "n_missing",
        F.round(F.col("n_missing") / F.greatest(F.col("_n"), F.lit(1)) * 100, 2).alias("pct_missing"))


NARROW = 3  # fixed-width columns up to which a row is as short as its digest


def _folded(df: DataFrame) -> DataFrame:
    """NaN as NULL, so that missing values compare equal."""
    return df.select(*[F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if isinstance(f.dataType, FLOAT_TYPES) else col(f.name)
                       for f in df.schema.fields])


def is_narrow(df: DataFrame) -> bool:
    return len(df.columns) <= NARROW and all(type(f.dataType) in _WIDTHS for f in df.schema.fields)


def row_digest(df: DataFrame) -> list:
    """Two 64-bit hashes (_h1, _h2) of the whole row; which values are missing counts, as a hash skips NULLs."""
    cells = [col(f.name) if isinstance(f.dataType, ATOMIC_TYPES) else F.to_json(F.struct(col(f.name))) for f in df.schema.fields]
    absent = [col(c).isNull() for c in df.columns]
    return [F.xxhash64(*absent, *cells).alias("_h1"), F.xxhash64(F.lit(7), *cells, *absent).alias("_h2")]


def repeated_digests(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests with their number of rows, those of more than one row): only digests are shuffled, whatever a row's width."""
    counts = saved(keyed.select(*row_digest(keyed)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c")))
    return counts, counts.where("_c > 1").select("_h1", "_h2")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, distinct_rows, duplicate_rows (missing values compare equal).

    Rows are counted by digest; the rows of repeated digests alone are grouped whole, which settles them. A row repeated
    a billion times costs one row per map task before each shuffle. Narrow rows are grouped as they are.
    """
    keyed = _folded(df)

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))

    if is_narrow(df):
        totals = distinct(keyed).agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    else:
        counts, repeated = repeated_digests(keyed)
        again = distinct(keyed.select("*", *row_digest(keyed)).join(repeated, ["_h1", "_h2"], "left_semi").drop("_h1", "_h2"))
        totals = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"), F.count_if(F.col("_c") == 1).alias("_alone")).crossJoin(
            F.broadcast(again.agg(F.count(F.lit(1)).alias("_more")))).select("n_rows", (F.col("_alone") + F.col("_more")).alias("distinct_rows"))
    return totals.select("n_rows", "distinct_rows", (F.col("n_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def ranked_values(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, v, cnt, before, n): value counts with their rank offsets."""
    return ranked_counts(df, columns, keys)


def quantiles_from_ranked(ranked: DataFrame, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, prob, value) from a ``ranked_values`` table (see ``quantiles.pick_quantiles``)."""
    return pick_quantiles(ranked, probs, keys)


def _pivot_probs(qs: DataFrame, probs: list[float], names: list[str], keys: list[str]) -> DataFrame:
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return qs.groupBy(*keys, "column_name").agg(*aggs)


SUMMARY_SCHEMA = ("column_name string, ordinal int, count long, mean double, std double, min double, "
                  "p25 double, p50 double, p75 double, max double")


def summary_specs(df: DataFrame, columns: list[str]) -> list[tuple]:
    """Aggregates of the plain moments of each column, for one scan."""
    specs = []
    for i, c in enumerate(columns):
        v = num(df, c)
        specs += [(f"n{i}", F.count(v), 1), (f"a{i}", F.avg(v), 2), (f"s{i}", F.stddev_samp(v), 3),
                  (f"lo{i}", F.min(v), 1), (f"hi{i}", F.max(v), 1)]
    return specs


def summary_rows(df: DataFrame, columns: list[str], quartiles: dict[str, list], row: dict) -> list[tuple]:
    """Rows of ``SUMMARY_SCHEMA`` from the quartiles and the aggregates of ``summary_specs``."""
    return [(c, df.columns.index(c), row[f"n{i}"], row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"], *quartiles[c], row[f"hi{i}"])
            for i, c in enumerate(columns)]


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, ordinal, count, mean, std, min, p25, p50, p75, max) — pandas ``describe``.

    Exact quartiles in three scans (``brackets``), the moments on the way of the second; one row per column comes back
    through the driver. ``exact=False`` takes ``percentile_approx``.
    """
    columns = columns if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], SUMMARY_SCHEMA)
    if exact:
        quartiles, _, row = column_quantiles(df, columns, SUMMARY_PROBS, more=lambda _: summary_specs(df, columns))
    else:
        from .quantiles import quantiles
        from ..functions.aggregates import one_row_agg

        row = one_row_agg(df, summary_specs(df, columns)).first().asDict()
        near = {(r["column_name"], r["prob"]): r["value"] for r in quantiles(df, columns, SUMMARY_PROBS, exact=False).collect()}
        quartiles = {c: [near.get((c, p)) for p in SUMMARY_PROBS] for c in columns}
    return spark.createDataFrame(summary_rows(df, columns, quartiles, row), SUMMARY_SCHEMA)


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, count) over the string form of each value, nulls dropped."""
    columns = columns if columns is not None else categorical_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in columns])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """(column_name, rank, value, count): k most frequent values; ties by value ascending.

    ``row_number() <= k`` over ``partitionBy(column)`` is planned as a
    WindowGroupLimit, so only k rows per column and task reach the shuffle.
    """
    columns = columns if columns is not None else categorical_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value string, count long")
    freq = freq if freq is not None else value_frequencies(df, columns)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return (freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value", "count"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None, k: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """(column_name, n_distinct, rank, value, count) — P7 with distinct count per column; ``freq``: known frequencies."""
    columns = columns if columns is not None else categorical_columns(df)
    freq = freq if freq is not None else value_frequencies(df, columns)
    distinct = freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    top = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return distinct.join(top, "column_name").select("column_name", "n_distinct", "rank", "value", "count")


def iqr_fences(quartiles: dict[str, list]) -> dict[str, tuple[float, float, float, float]]:
    """(q1, q3, lower, upper) of each column that has values; fences 1.5 interquartile ranges beyond the quartiles."""
    return {c: (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in quartiles.items() if q1 is not None}


def iqr_bounds(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, q1, q3, lower, upper) with q -/+ 1.5 IQR; all-null columns skipped."""
    keys = keys or []
    columns = columns if columns is not None else numeric_columns(df)
    if not keys:
        fences = iqr_fences(column_quantiles(df, columns, [0.25, 0.75])[0])
        return df.sparkSession.createDataFrame([(c, *f) for c, f in fences.items()], "column_name string, q1 double, q3 double, lower double, upper double")
    qs = _pivot_probs(quantiles_from_ranked(ranked_values(df, columns, keys), [0.25, 0.75], keys), [0.25, 0.75], ["q1", "q3"], keys)
    iqr = F.col("q3") - F.col("q1")
    return qs.select(*keys, "column_name", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower"),
                     (F.col("q3") + 1.5 * iqr).alias("upper"))


def outliers(df: DataFrame, columns: list[str] | None = None, quartiles: dict[str, list] | None = None) -> DataFrame:
    """(column_name, q1, q3, lower, upper, n_outliers): values strictly outside the IQR fences.

    Three scans for the quartiles (none if ``quartiles`` gives q1 and q3 by column), one aggregate that counts against
    the fences.
    """
    from ..functions.aggregates import one_row_agg

    columns = columns if columns is not None else numeric_columns(df)
    schema = "column_name string, q1 double, q3 double, lower double, upper double, n_outliers long"
    if quartiles is None:
        quartiles = column_quantiles(df, columns, [0.25, 0.75])[0] if columns else {}
    fences = iqr_fences(quartiles)
    if not fences:
        return df.sparkSession.createDataFrame([], schema)
    held = list(fences)
    outside = [(f"o{i}", F.count(F.when((num(df, c) < F.lit(fences[c][2])) | (num(df, c) > F.lit(fences[c][3])), 1)), 1) for i, c in enumerate(held)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.lit(x).alias(n) for n, x in zip(("q1", "q3", "lower", "upper"), fences[c])],
                              F.col(f"o{i}").alias("n_outliers")) for i, c in enumerate(held)])
    return one_row_agg(df, outside).select(F.inline(rows))


WIDE = 24  # columns up to which pairs are single aggregate expressions


def pair_moments(df: DataFrame, columns: list[str], kind: str = "corr") -> DataFrame:
    """(a, b, i, j, value, n) for all ordered pairs.

    Without missing values (the common case) a two-pass centred form is used:
    the column means (one small aggregate, C numbers fetched), then sums of
    centred squares and cross-products (C + C(C-1)/2 one-slot sums, chunked
    under the codegen field limit). With missing values, or more than ``WIDE`` columns, all pairs come from one pass
    over the rows where both are present (``_gram_moments``).
    """
    from ..functions.aggregates import one_row_agg

    vals = {c: num(df, c) for c in columns}
    k = len(columns)
    # first pass: row count, non-missing counts and means together; complete data needs no other check
    means = one_row_agg(df, [("_rows", F.count(F.lit(1)), 1)] +
                        [(f"c{i}", F.count(vals[c]), 1) for i, c in enumerate(columns)] +
                        [(f"m{i}", F.avg(vals[c]), 2) for i, c in enumerate(columns)]).first()
    n = int(means["_rows"])
    complete = all(means[f"c{i}"] == n for i in range(k))
    if complete and k <= WIDE:
        # deviations from the first-pass means; expressions are sent as SQL text (one call each)
        dev = df.select(*[(vals[c] - F.lit(float(means[f"m{i}"] or 0.0))).alias(f"d{i}") for i, c in enumerate(columns)])
        specs = [(f"sd{i}", F.expr(f"sum(d{i})"), 1) for i in range(k)]
        specs += [(f"sq{i}", F.expr(f"sum(d{i} * d{i})"), 1) for i in range(k)]
        specs += [(f"x{i}_{j}", F.expr(f"sum(d{i} * d{j})"), 1) for i in range(k) for j in range(i + 1, k)]
        wide = one_row_agg(dev, specs)
        var = [f"try_divide(sq{i} - sd{i} * sd{i} / {n}D, {max(n - 1, 0)}D) AS v{i}" for i in range(k)]
        cov = [f"try_divide(x{i}_{j} - sd{i} * sd{j} / {n}D, {max(n - 1, 0)}D) AS c{i}_{j}"
               for i in range(k) for j in range(i + 1, k)]
        stage = wide.selectExpr(*var, *cov)
        if kind == "corr":
            diag = [f"CASE WHEN v{i} > 0 THEN 1.0D END AS r{i}_{i}" for i in range(k)]
            off = [f"CASE WHEN v{i} > 0 AND v{j} > 0 THEN least(1.0D, greatest(-1.0D, "
                   f"try_divide(c{i}_{j}, sqrt(v{i}) * sqrt(v{j})))) END AS r{i}_{j}"
                   for i in range(k) for j in range(i + 1, k)]
        else:
            diag = [f"v{i} AS r{i}_{i}" for i in range(k)]
            off = [f"c{i}_{j} AS r{i}_{j}" for i in range(k) for j in range(i + 1, k)]
        stage = stage.selectExpr(*diag, *off)
        structs = ", ".join(
            f"named_struct('a', '{a}', 'b', '{b}', 'i', {i}, 'j', {j}, 'value', r{min(i, j)}_{max(i, j)}, "
            f"'n', CAST({n} AS BIGINT))"
            for i, a in enumerate(columns) for j, b in enumerate(columns))
        return stage.selectExpr(f"inline(array({structs}))")
    return _gram_moments(df.select(*[(vals[c] - F.lit(float(means[f"m{i}"] or 0.0))).alias(f"d{i}") for i, c in enumerate(columns)]),
                         columns, kind)


def _gram_moments(dev: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(a, b, i, j, value, n) from one pass over deviations d0, d1, ... with or without missing values.

    With the mask m (1 where present) and the deviation d (0 where missing), every pairwise-complete count, sum, sum of
    squares and cross-product is a cell of the Gram matrix of [m, d, d * d]. Each task sends one row per cell and Spark
    sums them; the 9 * columns^2 sums come to the driver, whatever the number of rows, and give the columns^2 results.
    """
    return pair_table(dev.sparkSession, gram_sums(dev, len(columns)), columns, kind)


def gram_sums(dev: DataFrame, k: int):
    """(3, k, 3, k) Gram matrix of presence, deviation and squared deviation of the k columns."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros((3 * k, 3 * k))
        for batch in batches:
            d = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.float64)
            m = ~np.isnan(d)
            d = np.where(m, d, 0.0)
            u = np.hstack([m.astype(np.float64), d, d * d])
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(9 * k * k, dtype=np.int32)), pa.array(total.ravel())], ["cell", "s"])

    sums = dev.mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    gram = np.zeros(9 * k * k)
    for r in sums:
        gram[r["cell"]] = r["s"]
    return gram.reshape(3, k, 3, k)


def pair_table(spark, gram, columns: list[str], kind: str) -> DataFrame:
    """(a, b, i, j, value, n) of the correlations ("corr") or covariances of a Gram matrix."""
    import numpy as np

    k = len(columns)
    n, x, y, xy, xx, yy = gram[0, :, 0], gram[1, :, 0], gram[0, :, 1], gram[1, :, 1], gram[2, :, 0], gram[0, :, 2]
    with np.errstate(all="ignore"):
        cxx, cyy, cxy = xx - x * x / n, yy - y * y / n, xy - x * y / n
        if kind == "corr":
            # sums of squares below rounding error of their terms belong to constant columns
            value = np.where((cxx > xx * 1e-14) & (cyy > yy * 1e-14) & (n > 1), np.clip(cxy / np.sqrt(cxx * cyy), -1, 1), np.nan)
            np.fill_diagonal(value, np.where(np.isnan(np.diag(value)), np.nan, 1.0))
        else:
            value = np.where(n > 1, cxy / (n - 1), np.nan)
    rows = [(columns[i], columns[j], i, j, None if np.isnan(value[i, j]) else float(value[i, j]), int(n[i, j])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(rows, "a string, b string, i int, j int, value double, n long")


def pearson(df: DataFrame, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, i, j, r, n): full Pearson matrix over pairwise-complete rows, one aggregate.

    Diagonal is 1 (NULL for a constant column). ``digits`` rounds r. A
    constant column gives NULL instead of failing (Spark's ``corr`` raises
    under ANSI); the division is guarded.
    """
    columns = columns if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, i int, j int, r double, n long")
    out = pair_moments(df, columns, "corr").withColumnRenamed("value", "r")
    if digits is not None:
        out = out.withColumn("r", F.round("r", digits))
    return out


def strong_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7,
                 k: int = 20, matrix: DataFrame | None = None) -> DataFrame:
    """(a, b, r): |r| >= threshold for i < j, strongest first, at most k (a top-k report); ``matrix``: pearson() if known."""
    m = matrix if matrix is not None else pearson(df, columns)
    return (m.where((F.col("i") < F.col("j")) & (F.abs("r") >= threshold))
            .orderBy(F.abs("r").desc(), "i", "j").limit(k).select("a", "b", "r"))


# Fixed widths (bytes) used for the volume of fixed-size types.
_WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
           T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def data_volume(df: DataFrame, one: DataFrame | None = None) -> DataFrame:
    """(column_name, bytes, mb): text bytes for strings/binary, fixed width x rows otherwise.

    Stands in for the reference's in-memory footprint (values differ by design).
    """
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"_b{i}").alias("bytes"))
                     for i, f in enumerate(df.schema.fields)])
    return one_row(df, volume_specs(df), one).select(F.inline(rows)).withColumn("mb", F.round(F.col("bytes") / (1024.0 * 1024.0), 3))


def profile(df: DataFrame, shared=None) -> dict[str, DataFrame]:
    """The profile bundle as a dict of tables; ``shared`` (``plans.shared.Shared``) has what several of them need."""
    from ..plans.shared import Shared
    from .roles import datetime_columns, id_columns, target_candidates

    s = shared or Shared(df)
    return {
        "overview": overview(df, s.one, s.duplicates),
        "types": column_types(df),
        "missing": missing(df, s.one),
        "duplicates": s.duplicates,
        "volume": data_volume(df, s.one),
        "numeric_summary": s.numeric_summary(),
        "categorical_summary": categorical_summary(df, freq=s.frequencies),
        "outliers": outliers(df, quartiles={c: [q[0], q[2]] for c, q in s.quartiles.items()}),
        "correlations": s.pairs("corr"),
        "strong_pairs": strong_pairs(df, matrix=s.pairs("corr")),
        "datetime_columns": datetime_columns(df),
        "id_columns": id_columns(df),
        "target_candidates": target_candidates(df),
    }


def profile_by(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Grouped numeric summary: (keys..., column_name, count, mean, std, min, p25, p50, p75, max)."""
    columns = columns if columns is not None else [c for c in numeric_columns(df) if c not in keys]
    from .quantiles import long_values

    lv = long_values(df, columns, keys)
    moments = lv.groupBy(*keys, "column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    qs = _pivot_probs(quantiles_from_ranked(ranked_values(df, columns, keys), SUMMARY_PROBS, keys),
                      SUMMARY_PROBS, ["p25", "p50", "p75"], keys)
    return moments.join(qs, keys + ["column_name"], "left")
