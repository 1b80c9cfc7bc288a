"""Column roles: datetime, identifier, target and value-column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (ATOMIC_TYPES, DATETIME_TYPES, INTEGER_TYPES, NUMERIC_TYPES, as_text, col,
                                 is_missing, kind_of, numeric_columns, q)

# Fixed values (must equal the reference's rules).
# Name fragments that mark an identifier column.
ID_NAME_TOKENS = ["id", "kod", "code", "key", "uuid"]
# Name fragments that mark a target candidate, in the reference's order.
TARGET_KEYWORDS = ["target", "label", "y", "ciro", "satis", "sales", "revenue", "amount",
                   "tutar", "profit", "kar", "price", "fiyat", "score", "churn"]
# Name fragments preferred when choosing the value column of a series.
VALUE_KEYWORDS = ["ciro", "revenue", "sales", "satis", "satış", "tutar", "amount", "total"]
# Exact (lower-cased, trimmed) names of id-like columns skipped as value column.
ID_LIKE_NAMES = ["id", "index"]
# Exact names of quantity and unit-price columns for the derived revenue.
QUANTITY_NAMES = ["quantity", "miktar", "adet", "qty"]
PRICE_NAMES = ["unitprice", "price", "fiyat", "birim_fiyat", "birimfiyat"]
# Exact names of geographic columns.
LAT_NAMES = ["lat", "latitude", "enlem"]
LON_NAMES = ["lon", "lng", "longitude", "boylam"]

# Text date formats tried on string columns, ISO first, then day-first.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy",
    "dd-MM-yyyy",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
]
DATETIME_SHARE = 0.8
ID_SHARE = 0.9
REVENUE_COLUMN = "_computed_revenue"


def _parse_any(c, fmt: str):
    return F.try_to_timestamp(c, F.lit(fmt))


def datetime_formats(df: DataFrame) -> DataFrame:
    """(column_name, format, share) for every string column and format.

    One aggregate over the whole column: share of non-null values that parse
    with the format; text without a digit at either end is not tried.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, format string, share double")
    src = df.select(*[col(c) for c in cols])
    specs = []
    for c in cols:
        nn = F.count(col(c))
        dated = F.length(col(c)).between(8, 32) & col(c).rlike(r"^\s*\d.*\d\s*$")
        for i, fmt in enumerate(DATE_FORMATS):
            parsed = F.count(F.when(F.when(dated, _parse_any(col(c), fmt)).isNotNull(), 1))
            specs.append((c, fmt, i, F.try_divide(parsed.cast("double"), nn.cast("double"))))
    agg = src.agg(*[e.alias(f"s{j}") for j, (_, _, _, e) in enumerate(specs)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(fmt).alias("format"),
                              F.lit(i).alias("fmt_order"), F.col(f"s{j}").alias("share"))
                     for j, (c, fmt, i, _) in enumerate(specs)])
    return agg.select(F.inline(rows))


def datetime_columns(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, source, format): typed date columns and parseable text columns."""
    spark = df.sparkSession
    typed = [(f.name, i, "typed", None) for i, f in enumerate(df.schema.fields)
             if isinstance(f.dataType, DATETIME_TYPES)]
    typed_df = spark.createDataFrame(typed, "column_name string, ordinal int, source string, format string")
    ordinals = spark.createDataFrame([(f.name, i) for i, f in enumerate(df.schema.fields)],
                                     "column_name string, ordinal int")
    shares = datetime_formats(df).where(F.col("share") >= DATETIME_SHARE)
    best = shares.groupBy("column_name").agg(
        F.min_by("format", F.struct(-F.col("share"), F.col("fmt_order"))).alias("format"))
    text = best.join(F.broadcast(ordinals), "column_name").select(
        "column_name", "ordinal", F.lit("text").alias("source"), "format")
    return typed_df.unionByName(text)


def coerce_datetimes(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Parse the given text columns (name -> likely format); a value of another known format is read by that one,
    in the order of ``DATE_FORMATS``; only values that fit none become NULL."""
    out = []
    for f in df.schema.fields:
        if f.name in formats:
            order = [formats[f.name], *[x for x in DATE_FORMATS if x != formats[f.name]]]
            out.append(F.coalesce(*[_parse_any(col(f.name), x) for x in order]).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_distinct), nulls ignored, NaN is missing: one pass over all columns and two aggregates.

    Values are told apart by two 64-bit hashes of the typed value, so that no text is shuffled, however long.
    """
    columns = columns if columns is not None else df.columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    cells = F.array(*[F.when(~is_missing(df, c), F.struct(F.lit(i).alias("i"), F.xxhash64(_hashable(df, c)).alias("h1"),
                                                          F.xxhash64(F.lit(7), _hashable(df, c)).alias("h2"))) for i, c in enumerate(columns)])
    freq = df.select(F.inline(F.array_compact(cells))).groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("cnt"))
    names = F.array(*[F.lit(c) for c in columns])
    return freq.groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct")).select(names[F.col("i")].alias("column_name"), "n_distinct")


def _hashable(df: DataFrame, name: str):
    """A column that Spark can hash: maps and the like by their text."""
    kind = df.schema[name].dataType
    return col(name) if isinstance(kind, ATOMIC_TYPES) else as_text(df, name)


DISTINCT_ERROR = 0.02  # standard error of the sketches
SIGMAS = 6


def distinct_bounds(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Row count and, by column, bounds of the number of distinct values, from one pass with a HyperLogLog sketch each.

    The bounds are six standard errors wide and serve to leave columns out; what is reported is counted exactly.
    """
    sketches = [F.approx_count_distinct(F.when(~is_missing(df, c), _hashable(df, c)), DISTINCT_ERROR).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    margin = SIGMAS * DISTINCT_ERROR
    return row["rows"], {c: (row[f"d{i}"] * (1 - margin) - 2, row[f"d{i}"] * (1 + margin) + 2) for i, c in enumerate(columns)}


def _name_has_any(name: str, tokens: list[str]) -> bool:
    low = name.lower()
    return any(t in low for t in tokens)


def roles(df: DataFrame) -> DataFrame:
    """One row per column: type, kind, distinct ratio, id flag and target rank."""
    spark = df.sparkSession
    fields = df.schema.fields
    numeric = numeric_columns(df)
    ranks = target_rank_map(df)
    meta = spark.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType),
          isinstance(f.dataType, INTEGER_TYPES), _name_has_any(f.name, ID_NAME_TOKENS),
          ranks.get(f.name)) for i, f in enumerate(fields)],
        "column_name string, ordinal int, dtype string, kind string, is_integer boolean, "
        "id_name boolean, target_rank int")
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    dc = distinct_counts(df)
    out = (meta.join(F.broadcast(dc), "column_name", "left").crossJoin(F.broadcast(n_rows))
           .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long"))
           .withColumn("distinct_ratio", F.try_divide(F.col("n_distinct").cast("double"),
                                                      F.greatest(F.col("n_rows"), F.lit(1)).cast("double")))
           .withColumn("is_id", (F.col("n_rows") > 0) & (
               (F.col("id_name") & (F.col("distinct_ratio") >= ID_SHARE))
               | (F.col("is_integer") & (F.col("distinct_ratio") == 1.0)))))
    return out.select("column_name", "ordinal", "dtype", "kind", "n_rows", "n_distinct",
                      "distinct_ratio", "is_id", "target_rank")


def id_columns(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, n_distinct, distinct_ratio) of identifier-like columns.

    Only id-named and integer columns can be one; of those, a sketch leaves out all that are clearly below their share
    of distinct values, and the rest are counted exactly.
    """
    shares = {f.name: ID_SHARE if _name_has_any(f.name, ID_NAME_TOKENS) else 1.0 for f in df.schema.fields
              if _name_has_any(f.name, ID_NAME_TOKENS) or isinstance(f.dataType, INTEGER_TYPES)}
    spark = df.sparkSession
    schema = "column_name string, ordinal int, n_distinct long, distinct_ratio double"
    if not shares:
        return spark.createDataFrame([], schema)
    rows, bounds = distinct_bounds(df, list(shares))
    open_ = [c for c, share in shares.items() if rows and bounds[c][1] >= share * rows]
    if not open_:
        return spark.createDataFrame([], schema)
    meta = spark.createDataFrame([(c, df.columns.index(c), shares[c]) for c in open_], "column_name string, ordinal int, share double")
    ratio = F.col("n_distinct") / F.lit(float(rows))
    return (distinct_counts(df, open_).join(F.broadcast(meta), "column_name").withColumn("distinct_ratio", ratio)
            .where(F.col("distinct_ratio") >= F.col("share")).select("column_name", "ordinal", "n_distinct", "distinct_ratio"))


def _ranked(names: list[str], rules: list) -> list[str]:
    """Names ordered by (number of the first rule that holds, position); names that no rule holds for are left out."""
    classed = [(next((n for n, holds in enumerate(rules) if holds(c)), None), i, c) for i, c in enumerate(names)]
    return [c for n, _, c in sorted((x for x in classed if x[0] is not None), key=lambda x: x[:2])]


def target_rank_map(df: DataFrame, limit: int | None = 10) -> dict[str, int]:
    """Rank of each target candidate: keyword-named columns, then numerics; at most ``limit`` (None: all)."""
    numeric = set(numeric_columns(df))
    order = _ranked(df.columns, [lambda c: _name_has_any(c, TARGET_KEYWORDS), numeric.__contains__])
    return dict(zip(order[:limit], range(1, len(order) + 1)))


def target_candidates(df: DataFrame, limit: int = 10) -> DataFrame:
    ranks = target_rank_map(df, limit)
    return df.sparkSession.createDataFrame(
        [(c, r) for c, r in sorted(ranks.items(), key=lambda kv: kv[1])],
        "column_name string, target_rank int")


def _id_like(name: str) -> bool:
    low = name.strip().lower()
    return low in ID_LIKE_NAMES or low.endswith("id")


# The value column of a series: the first column of the first class that has any.
VALUE_RULES = [lambda c: _name_has_any(c.strip(), VALUE_KEYWORDS), lambda c: not _id_like(c), lambda c: True]
# The factors of the derived revenue by name.
REVENUE_FACTORS = [QUANTITY_NAMES, PRICE_NAMES]


def resolve_value_column(numeric_cols: list[str]) -> str | None:
    """Value column for a series: the best-classed numeric by ``VALUE_RULES``, None without numerics."""
    return (_ranked(numeric_cols, VALUE_RULES) or [None])[0]


def find_revenue_inputs(df: DataFrame) -> list[str | None]:
    """The column of each factor in ``REVENUE_FACTORS``, None where the table has none."""
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    present = [sorted((by_name[n] for n in names if n in by_name), key=df.columns.index) for names in REVENUE_FACTORS]
    return [(p or [None])[0] for p in present]


def with_revenue(df: DataFrame) -> tuple[DataFrame, str | None]:
    """Add ``_computed_revenue = quantity * price`` (non-numeric text -> NULL) when both exist."""
    qty, price = find_revenue_inputs(df)
    if qty is None or price is None:
        return df, None
    rev = (F.expr(f"try_cast({q(qty)} as double)") * F.expr(f"try_cast({q(price)} as double)"))
    return df.withColumn(REVENUE_COLUMN, rev), REVENUE_COLUMN


def numeric_projection(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def categorical_projection(df: DataFrame) -> DataFrame:
    return df.select(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)])


def low_cardinality_columns(df: DataFrame, max_distinct: int = 8) -> DataFrame:
    """Non-numeric columns with at most ``max_distinct`` distinct values (nulls ignored): (column_name, n_distinct, ordinal).

    Columns that a sketch shows to have clearly more are not counted, so the counting shuffles few rows per task.
    """
    cats = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    spark = df.sparkSession
    bounds = distinct_bounds(df, cats)[1] if cats else {}
    few = [c for c in cats if bounds[c][0] <= max_distinct]
    if not few:
        return spark.createDataFrame([], "column_name string, n_distinct long, ordinal int")
    ordinals = spark.createDataFrame([(c, df.columns.index(c)) for c in few], "column_name string, ordinal int")
    return (distinct_counts(df, few).join(F.broadcast(ordinals), "column_name")
            .where(F.col("n_distinct") <= max_distinct))


def geo_columns(df: DataFrame) -> tuple[str | None, str | None]:
    low = {c.lower(): c for c in df.columns}
    lat = next((low[k] for k in low if k in LAT_NAMES), None)
    lon = next((low[k] for k in low if k in LON_NAMES), None)
    return lat, lon
