"""Table sources and sinks (S3, S5, S6, S9): format dispatch, load metadata,
validation checks and writers."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

# Suffixes per format.
DELIMITED = (".csv", ".txt", ".tsv")
WORKBOOK = (".xlsx", ".xlsm")
NATIVE = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


class LoadError(ValueError):
    """Input that cannot be read (missing, unsupported, empty, undecodable)."""


def _suffix(path: str) -> str:
    base = path.rstrip("/").split("/")[-1]
    return os.path.splitext(base)[1].lower()


def read_table(spark: SparkSession, path: str | list[str], fmt: str | None = None,
               sheet: str | int | None = None, allow_empty: bool = False, **options) -> DataFrame:
    """S3: read a file, directory, glob or list with the reader its suffix (or ``fmt``) names.

    Whatever can't be read (missing, of unknown type, broken, without the
    sheet, in an unknown code page, without rows unless ``allow_empty``)
    raises ``LoadError``; later failures of a file's contents are Spark's.

    Delimited text goes through encoding/delimiter detection (S1),
    workbooks through the distributed workbook reader (S2); a directory
    without suffix is read as parquet.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise LoadError("no path given")
    try:
        df = _open(spark, paths, fmt, sheet, options)
        return df if allow_empty else require_non_empty(df)
    except LoadError:
        raise
    except (PySparkException, LookupError, ValueError) as problem:
        raise LoadError(f"{paths[0]}: {str(problem).splitlines()[0]}") from problem


def _open(spark: SparkSession, paths: list[str], fmt: str | None, sheet: str | int | None, options: dict) -> DataFrame:
    suffix = fmt and f".{fmt.lstrip('.')}" or _suffix(paths[0])
    if suffix in DELIMITED or fmt in ("csv", "tsv", "txt"):
        from .delimited import read_delimited

        return read_delimited(spark, paths, tsv=suffix == ".tsv", **options)
    if suffix in WORKBOOK or fmt in ("xlsx", "workbook"):
        from .workbook import open_workbooks

        return open_workbooks(spark, paths, sheet)
    if suffix == ".xls":
        raise LoadError("legacy binary .xls workbooks are not supported")
    kind = NATIVE.get(suffix, fmt or ("parquet" if suffix == "" else None))
    if kind is None:
        raise LoadError(f"unsupported file type: {suffix}")
    return spark.read.format(kind).options(**options).load(paths)


def load_meta(df: DataFrame) -> DataFrame:
    """(file_name, suffix, rows, columns) per input file of a file-based DataFrame."""
    n_cols = len(df.columns)
    return (df.select(F.col("_metadata.file_name").alias("file_name")).groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("file_name", F.lower(F.regexp_extract("file_name", r"\.[^.]*$", 0)).alias("suffix"), "rows", F.lit(n_cols).cast("long").alias("columns")))


def checks(df: DataFrame, required: list[str] | None = None, not_null: list[str] | None = None,
           unique: list[str] | None = None) -> DataFrame:
    """(check, column_name, ok, n_bad) — required columns, emptiness, NULL counts and
    duplicate keys, from one aggregate plus one grouped count per unique key."""
    spark = df.sparkSession
    rows = []
    for c in required or []:
        rows.append(("required", c, c in df.columns, 0 if c in df.columns else 1))
    parts = [spark.createDataFrame(rows, "check string, column_name string, ok boolean, n_bad long")]
    nn = [c for c in (not_null or []) if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(col(c).isNull(), 1)).alias(f"_z{i}") for i, c in enumerate(nn)])
    structs = [F.struct(F.lit("not_empty").alias("check"), F.lit(None).cast("string").alias("column_name"),
                        (F.col("_n") > 0).alias("ok"), F.when(F.col("_n") > 0, 0).otherwise(1).cast("long").alias("n_bad"))]
    structs += [F.struct(F.lit("not_null").alias("check"), F.lit(c).alias("column_name"), (F.col(f"_z{i}") == 0).alias("ok"),
                         F.col(f"_z{i}").cast("long").alias("n_bad")) for i, c in enumerate(nn)]
    parts.append(agg.select(F.inline(F.array(*structs))))
    for c in unique or []:
        if c not in df.columns:
            continue
        dup = df.groupBy(col(c)).agg(F.count(F.lit(1)).alias("_k")).agg(
            F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k") - 1)), F.lit(0)).cast("long").alias("n_bad"))
        parts.append(dup.select(F.lit("unique").alias("check"), F.lit(c).alias("column_name"),
                                (F.col("n_bad") == 0).alias("ok"), "n_bad"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_non_empty(df: DataFrame) -> DataFrame:
    """Raise ``LoadError`` for an empty table (one row is fetched, not the table)."""
    if df.isEmpty():
        raise LoadError("the table is empty")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, **options) -> None:
    """Write with any Spark writer (parquet, csv, json, orc) or as workbooks (``xlsx``)."""
    if fmt in ("xlsx", "workbook"):
        from .workbook import write_workbooks

        write_workbooks(df, path)
        return
    w = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.options(**{"header": "true", "escape": '"', **options})
    w.save(path)
