"""Shared-folder tables, data volumes and bucket counts used by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def saved(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared checkpoint folder and read it back (cuts lineage, survives executors)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_volume(df: DataFrame, text: str) -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def bucket_count(amount: float, per_bucket: float) -> int:
    """Buckets so that each holds about ``per_bucket``."""
    return max(1, math.ceil(amount / per_bucket))


def plain(name: str) -> Column:
    """A column by its literal name (dots are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words of a text (not null) in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def fixed(*columns: Column) -> Column:
    """The columns as the single row of a generator: computed once a row, and no filter of a caller is pushed below them
    (pushed filters repeat the expressions they name, and would split the text again for each word)."""
    return F.inline(F.array(F.struct(*columns)))


def keep_ids(df: DataFrame, doc_id: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of a frame with the first column of ``ids``, null ids equal; the frame's columns stay."""
    key = fresh(df, "_id")
    ids = ids.select(plain(ids.columns[0]).alias(key))
    return df.join(ids, plain(doc_id).eqNullSafe(F.col(key)), how)


LOW = (1 << 33) - 1  # row number inside a partition, in monotonically_increasing_id


def positions(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """rows, which must be stable from one pass to the next, with ``pos`` (from 0) and ``n`` (rows) within their part.

    ``part`` holds no nulls. Rows that tie in the order are told apart by a row id, so that equal rows spread over
    partitions too. Rows are range-partitioned by part and order and numbered inside their partition, then shifted by a
    table of one row per partition and part: no part, however large, is numbered in one task.
    """
    keys = [F.col(c) for c in (part, *order, "_row")]
    ranged = saved(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .select(*rows.columns, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(LOW)).alias("_at")))
    runs = ranged.groupBy(part, "_task").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    same = Window.partitionBy(part)
    before = F.coalesce(F.sum("_count").over(same.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = runs.select(part, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(same).alias("n"))
    return ranged.join(shifts, [part, "_task"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
