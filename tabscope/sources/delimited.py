"""Delimited text with encoding and delimiter detection.

Every file is judged by all its bytes: one distributed pass over the lines counts, by file, lines that are not UTF-8,
lines with bytes of Turkish letters, lines with quotes and the field counts under each candidate delimiter; files with
quotes are then judged by their records. The result has one row per file. Files of equal encoding and delimiter are read
by one scan, the scans are united by column name.
"""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import saved
from . import quoted
from .tables import LoadError, load_meta

# Candidate delimiters in the reference's order.
DELIMITERS = [",", ";", "|", "\t"]
# Bytes of the Turkish letters in windows-1254, as Latin-1 shows them.
TURKISH_BYTES = "\u00d0\u00dd\u00de\u00f0\u00fd\u00fe"
DELIMITER_SHARE = 0.8
SCANNED = ("utf-8", "iso8859-1", "ascii")


def _order(tsv: bool) -> list[str]:
    return list(dict.fromkeys((["\t"] if tsv else []) + DELIMITERS))


def detect_files(spark: SparkSession, paths: str | list[str], tsv: bool = False) -> DataFrame:
    """(file, encoding, delimiter, crosses): one row per file with any line that is not blank, judged by all its records.

    UTF-8 if every line is; else the Turkish code page if a line holds a byte of a Turkish letter, else Latin-1. The
    delimiter is the first (tab first for ``tsv``) whose most frequent field count is above 1 and holds for at least
    80 % of the records; without any, the first of that order. In a file with quotes, what they enclose counts for
    nothing (``quoted``); crosses tells that records hold line breaks.
    """
    return _detected(spark, paths, tsv).select("file", "encoding", "delimiter", "crosses")


def _detected(spark: SparkSession, paths: str | list[str], tsv: bool) -> DataFrame:
    """detect_files with blocks, entries and begins (see ``quoted.compose``) of the files with quotes."""
    order = _order(tsv)
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("utf8"), latin.alias("line")).where(F.trim("line") != "")
    widths = F.array(*[F.struct(F.lit(n).alias("place"), (F.length("line") - F.length(F.replace("line", F.lit(sep))) + 1).alias("fields"))
                       for n, sep in enumerate(order)])
    counts = saved(lines.select("file", "utf8", F.col("line").rlike(f"[{TURKISH_BYTES}]").alias("turkish"), F.contains("line", F.lit('"')).alias("quotes"),
                                F.inline(widths)).groupBy("file", "place", "fields").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("utf8")).alias("bad"), F.count_if(F.col("turkish")).alias("turkish"),
        F.count_if("quotes").alias("quotes")))
    by_file = counts.where("place = 0").groupBy("file").agg(F.sum("bad").alias("bad"), F.sum("turkish").alias("turkish"), F.sum("quotes").alias("quotes"))
    encoding = F.when(F.col("bad") == 0, "UTF-8").when(F.col("turkish") > 0, "windows-1254").otherwise("ISO-8859-1")
    plain = by_file.where("quotes = 0").select("file").join(counts, "file").select("file", "place", "fields", "n")
    marked = [r["file"] for r in by_file.where("quotes > 0").select("file").collect()]  # file names only
    none = F.array().cast("array<long>")
    states = None
    if marked:
        composed = saved(quoted.compose(quoted.pieces(quoted.lines_of(spark, marked), order)))
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("sep")).cast("int") - 1
        states = composed.select("file", place.alias("place"), "crosses", "blocks", "entries", "begins")
        plain = plain.unionByName(composed.select("file", place.alias("place"), F.inline(F.arrays_zip("fields", "counts"))).withColumnRenamed("counts", "n"))
    # per file and delimiter: all records, and the most frequent field count
    by_place = plain.groupBy("file", "place").agg(F.sum("n").alias("records"), F.max("n").alias("most"), F.max_by("fields", F.struct("n", "fields")).alias("fields"))
    fits = (F.col("fields") > 1) & (F.col("most") >= DELIMITER_SHARE * F.col("records"))
    files = by_place.groupBy("file").agg(F.coalesce(F.min(F.when(fits, F.col("place"))), F.lit(0)).alias("place"))
    out = files.join(by_file, "file").select("file", "place", encoding.alias("encoding"), F.array(*[F.lit(x) for x in order])[F.col("place")].alias("delimiter"))
    if states is None:
        return out.select("*", F.lit(False).alias("crosses"), none.alias("blocks"), none.cast("array<int>").alias("entries"), none.alias("begins"))
    return out.join(states, ["file", "place"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))


class Format:
    """Files of one encoding and delimiter; starts: the pieces of files whose records cross lines, else None."""

    def __init__(self, encoding: str, delimiter: str, files: list[str], starts: dict | None = None):
        self.encoding, self.delimiter, self.files, self.starts = encoding, delimiter, files, starts

    def by_pieces(self) -> bool:
        """Whether records cross lines, or Spark's own scan doesn't know the code page."""
        return self.starts is not None or codecs.lookup(self.encoding).name not in SCANNED


def _formats(spark: SparkSession, paths: list[str], encoding: str | None, delimiter: str | None, tsv: bool) -> list[Format]:
    """One entry per format, the one of most files first; the driver holds file names, and pieces of files whose records
    cross lines."""
    found = _detected(spark, paths, tsv)
    if delimiter:
        if delimiter not in _order(tsv):
            raise LoadError(f"delimiter {delimiter!r} is none of {DELIMITERS}")
        states = _states(spark, paths, delimiter)
        found = found.select("file", "encoding").withColumn("delimiter", F.lit(delimiter)).join(states, "file", "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))
    if encoding:
        found = found.withColumn("encoding", F.lit(encoding))
    rows = (found.groupBy("encoding", "delimiter", "crosses").agg(F.sort_array(F.collect_list("file")).alias("files"))
            .orderBy(F.size("files").desc(), "encoding", "delimiter", "crosses").collect())
    out = []
    for r in rows:
        starts = None
        if r["crosses"]:
            own = found.where(F.col("crosses") & (F.col("encoding") == r["encoding"]) & (F.col("delimiter") == r["delimiter"]))
            starts = {(x["file"], b): (e, s) for x in own.select("file", "blocks", "entries", "begins").collect()
                      for b, e, s in zip(x["blocks"], x["entries"], x["begins"])}
        out.append(Format(r["encoding"], r["delimiter"], r["files"], starts))
    return out or [Format(encoding or "UTF-8", delimiter or ("\t" if tsv else ","), paths)]


def _states(spark: SparkSession, paths: list[str], delimiter: str) -> DataFrame:
    """file, crosses, blocks, entries, begins under a given delimiter."""
    return quoted.compose(quoted.pieces(quoted.lines_of(spark, paths), [delimiter])).select("file", "crosses", "blocks", "entries", "begins")


def detect_csv(spark: SparkSession, paths: str | list[str], encoding: str | None = None,
               delimiter: str | None = None, tsv: bool = False) -> dict:
    """Encoding and delimiter of most files (``detect_files`` has those of each)."""
    first = _formats(spark, [paths] if isinstance(paths, str) else list(paths), encoding, delimiter, tsv)[0]
    return {"encoding": first.encoding, "delimiter": first.delimiter}


def _read(spark: SparkSession, fmt: Format, header: bool, infer_schema: bool, schema) -> DataFrame:
    if fmt.by_pieces():
        df = quoted.read_quoted(spark, fmt.files, fmt.encoding, fmt.delimiter, header, infer_schema and schema is None, fmt.starts or {})
        return df if schema is None else df.select(*[F.col(q(f.name)).cast(f.dataType) for f in schema.fields])
    reader = (spark.read.option("encoding", fmt.encoding).option("sep", fmt.delimiter).option("escape", '"')
              .option("header", str(header).lower()).option("multiLine", "false"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", str(infer_schema).lower())
    df = reader.csv(fmt.files)
    first = df.columns[0] if df.columns else None
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first and first.startswith("\ufeff") else df


def read_delimited(spark: SparkSession, paths: str | list[str], encoding: str | None = None,
                   delimiter: str | None = None, tsv: bool = False, header: bool = True,
                   infer_schema: bool = True, schema=None) -> DataFrame:
    """Detect by file, one scan per format, united by column name; a BOM is dropped from the first header.

    Quotes enclose delimiters, doubled quotes and line breaks. Files without line breaks inside quotes are read by
    Spark's CSV scan, those with them or of another code page than Latin-1 by pieces (``quoted``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [_read(spark, fmt, header, infer_schema, schema) for fmt in _formats(spark, paths, encoding, delimiter, tsv)]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def delimited_meta(spark: SparkSession, paths: str | list[str], **kw) -> DataFrame:
    """S5 for text files: (encoding, delimiter, file_name, suffix, rows, columns), formats as detected by file."""
    metas = []
    paths = [paths] if isinstance(paths, str) else list(paths)
    for fmt in _formats(spark, paths, kw.get("encoding"), kw.get("delimiter"), kw.get("tsv", False)):
        df = _read(spark, fmt, kw.get("header", True), False, None)
        if fmt.by_pieces():  # records are counted by file before they are parsed
            rows = quoted.records(quoted.lines_of(spark, fmt.files), fmt.delimiter, fmt.starts or {})
            head = 1 if kw.get("header", True) else 0
            meta = rows.groupBy(F.element_at(F.split("file", "/"), -1).alias("file_name")).agg((F.count(F.lit(1)) - head).alias("rows")).withColumn(
                "columns", F.lit(len(df.columns)).cast("long"))
        else:
            meta = load_meta(df).drop("suffix")
        suffix = F.lower(F.regexp_extract("file_name", r"\.[^.]*$", 0)).alias("suffix")
        metas.append(meta.select(F.lit(fmt.encoding).alias("encoding"), F.lit(fmt.delimiter).alias("delimiter"), "file_name", suffix, "rows", "columns"))
    out = metas[0]
    for m in metas[1:]:
        out = out.unionByName(m)
    return out
