"""Workbook sources and sinks (S2, S9) for directories of ``.xlsx`` files.

``binaryFile`` lists and reads the files, one row per workbook; an Arrow
``mapInPandas`` opens each workbook with the standard library (zip + XML) and
emits one row per sheet row, so thousands of workbooks parse in parallel.
A workbook is the unit of work (a zip cannot be split).
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import saved

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
RAW_SCHEMA = "path string, sheet string, sheet_index int, row int, cells array<string>"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as fh:
        for _, si in ET.iterparse(fh):
            if _tag(si) == "si":
                out.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
                si.clear()
    return out


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, member of the archive) in the workbook's order; sheets without cells of their own are left out."""
    names = set(z.namelist())
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in rels.findall("pr:Relationship", _NS)}
    out = []
    for sheet in book.find("m:sheets", _NS).findall("m:sheet", _NS):
        target = targets.get(sheet.get(f"{{{_NS['r']}}}id"), "")
        target = target if target.startswith("xl/") else "xl/" + target
        if target in names:
            out.append((sheet.get("name"), target))
    return out


def _value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(f"{{{_NS['m']}}}t"))
    v = cell.find("m:v", _NS)
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else {"1": "true"}.get(v.text, "false") if kind == "b" else v.text


def sheet_rows(data: bytes, sheet: str | int | None = None):
    """(sheet, sheet_index, row, cells) of the chosen sheet (name or index) or of all, parsed row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _shared_strings(z)
        for index, (name, member) in enumerate(sheets_of(z)):
            if sheet is not None and sheet not in (name, index):
                continue
            with z.open(member) as fh:
                at = -1
                for _, row in ET.iterparse(fh):
                    if _tag(row) != "row":
                        continue
                    at = int(row.get("r")) - 1 if row.get("r") else at + 1
                    cells: dict[int, str | None] = {}
                    for c in row.findall("m:c", _NS):
                        place = _col_index(c.get("r")) if c.get("r") else (max(cells) + 1 if cells else 0)
                        cells[place] = _value(c, shared)
                    yield name, index, at, [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]
                    row.clear()


ROWS_AT_ONCE = 2000


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(paths).select("path", "content")


def read_workbooks(spark: SparkSession, paths: str | list[str], sheet: str | int | None = None) -> DataFrame:
    """Raw rows (path, sheet, sheet_index, row, cells) of every workbook under ``paths``, of one sheet or all."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(bytes(content), sheet)
                while part := [(path, *r) for r in islice(rows, ROWS_AT_ONCE)]:
                    yield pd.DataFrame(part, columns=["path", "sheet", "sheet_index", "row", "cells"])

    return _files(spark, paths).mapInPandas(parse, RAW_SCHEMA)


def workbook_sheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sheets, error): the sheet names of every workbook, or why it can't be opened."""

    def look(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        out.append((path, [name for name, _ in sheets_of(z)], None))
                except Exception as problem:  # noqa: BLE001 - whatever is wrong with the file is reported with its name
                    out.append((path, [], f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(out, columns=["path", "sheets", "error"])

    return _files(spark, paths).mapInPandas(look, "path string, sheets array<string>, error string")


def open_workbooks(spark: SparkSession, paths: str | list[str], sheet: str | int | None = None) -> DataFrame:
    """Typed table of one sheet (name or index, the first by default) of all workbooks, columns by header.

    Raises ``LoadError`` for a broken workbook, for one without the sheet, and where no row is found.
    """
    from .tables import LoadError

    chosen = sheet if sheet is not None else 0
    lacking = F.col("error").isNotNull() | (~F.array_contains("sheets", chosen) if isinstance(chosen, str) else F.size("sheets") <= chosen)
    bad = workbook_sheets(spark, paths).where(lacking).orderBy("path").first()
    if bad is not None:
        raise LoadError(f"{bad['path']}: {bad['error'] or f'no sheet {sheet!r} among {bad['sheets']}'}")
    return workbook_table(read_workbooks(spark, paths, chosen), chosen)


def workbook_meta(spark: SparkSession, paths: str | list[str], sheet: str | int | None = None) -> DataFrame:
    """S5 of workbooks: (file_name, suffix, sheets, selected_sheet, rows, columns), rows without the header."""
    chosen = sheet if sheet is not None else 0
    listed = workbook_sheets(spark, paths).where("error is null")
    rows = read_workbooks(spark, paths, chosen).groupBy("path").agg(
        (F.count(F.lit(1)) - 1).alias("rows"), F.min_by(F.size("cells"), "row").cast("long").alias("columns"))
    name = F.element_at(F.split("path", "/"), -1)
    selected = F.lit(chosen) if isinstance(chosen, str) else F.get("sheets", F.lit(chosen))
    return listed.join(rows, "path", "left").select(name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("suffix"), "sheets",
                                                    selected.alias("selected_sheet"), F.coalesce("rows", F.lit(0)).alias("rows"),
                                                    F.coalesce("columns", F.lit(0)).alias("columns"))


def workbook_table(raw: DataFrame, sheet: str | int | None = None, header: bool = True) -> DataFrame:
    """Typed table from raw workbook rows: the chosen sheet (name, index or first), each workbook's first row as its header.

    Columns are united by name over the workbooks, in order of appearance by path; a workbook that lacks one has nulls
    there. Columns whose every value parses as a number become DOUBLE (BIGINT if integral). The distinct headers and the
    type decision (one aggregate row) are fetched to build the schema.
    """
    from .tables import LoadError

    part = raw.where(F.col("sheet") == sheet if isinstance(sheet, str) else F.col("sheet_index") == (sheet or 0))
    part = saved(part)  # workbooks are parsed once
    heads = part.groupBy("path").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"), F.max(F.size("cells")).alias("width"))
    if header:
        names = F.transform("head", lambda c, i: F.coalesce(c, F.concat(F.lit("column_"), i.cast("string"))))
    else:
        names = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("column_"), (i - 1).cast("string")))
    heads = heads.withColumn("names", names)
    columns = list(dict.fromkeys(n for r in heads.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect() for n in r["names"]))
    if not columns:
        raise LoadError(f"sheet {sheet!r} not found or empty")
    # repeated names of one header: the first place counts
    places = F.map_from_entries(F.filter(F.transform("names", lambda n, i: F.struct(n.alias("name"), (i + 1).alias("place"))),
                                         lambda e: F.array_position("names", e["name"]) == e["place"]))
    body = part.join(heads.select("path", "first", places.alias("places")), "path")
    body = body.where(F.col("row") > F.col("first")) if header else body
    wide = body.select(*[F.try_element_at("cells", F.try_element_at("places", F.lit(n)).cast("int")).alias(n) for n in columns])
    number = [F.expr(f"try_cast({q(n)} AS DOUBLE)") for n in columns]
    probe = wide.agg(*[F.count(F.col(q(n))).alias(f"n{i}") for i, n in enumerate(columns)], *[F.count(d).alias(f"d{i}") for i, d in enumerate(number)],
                     *[F.count(F.when(d != F.expr(f"try_cast(try_cast({q(n)} AS DOUBLE) AS BIGINT)"), 1)).alias(f"f{i}")
                       for i, (n, d) in enumerate(zip(columns, number))]).first()
    out = []
    for i, n in enumerate(columns):
        numeric = probe[f"n{i}"] > 0 and probe[f"d{i}"] == probe[f"n{i}"]
        kind = "bigint" if probe[f"f{i}"] == 0 else "double"
        out.append((F.expr(f"try_cast(try_cast({q(n)} AS DOUBLE) AS {kind})") if numeric else F.col(q(n))).alias(n))
    return wide.select(*out)


def _cell(ref: str, value) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, (bool,)):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{repr(float(value)) if isinstance(value, float) else value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def _letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


class SheetWriter:
    """A workbook of one sheet (``data``), its rows written to the stream as they come."""

    def __init__(self, stream, columns: list[str]):
        self.zip, self.rows = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), 0
        for name, text in _PARTS.items():
            self.zip.writestr(name, text)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._put(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_NS["m"]}"><sheetData>')
        self.add(columns)

    def _put(self, text: str) -> None:
        self.sheet.write(text.encode())

    def add(self, values) -> None:
        self.rows += 1
        self._put(f'<row r="{self.rows}">' + "".join(_cell(f"{_letters(j)}{self.rows}", v) for j, v in enumerate(values)) + "</row>")

    def close(self) -> None:
        self._put("</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


_PARTS = {
    "[Content_Types].xml":
        '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        '</Types>',
    "_rels/.rels":
        f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["pr"]}">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
        'Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml":
        f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}">'
        '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels":
        f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["pr"]}">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
        'Target="worksheets/sheet1.xml"/></Relationships>',
}


def _target(path: str):
    """(file system, path in it) of a folder given by path or URI, on whichever process asks."""
    from pyarrow import fs

    if path.startswith("file:") or ":/" not in path:
        return fs.LocalFileSystem(), os.path.abspath("/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


SHEET_ROWS = 1 << 20  # rows that a sheet can hold, its header included


def write_workbooks(df: DataFrame, path: str) -> DataFrame:
    """Workbooks (sheet ``data``) under ``path``, a shared folder or a URI that pyarrow can write.

    A partition gives one workbook, or as many as its rows need at ``SHEET_ROWS`` a sheet; rows are written as they come.
    Returns the (file, rows) written, evaluated eagerly.
    """
    cols = df.columns
    path = path if ":/" in path else os.path.abspath(path)
    run = uuid.uuid4().hex[:8]  # one name a workbook: a task that runs again writes its files anew

    def write(batches):
        from pyspark import TaskContext

        system, folder = _target(path)
        done, book, stream = [], None, None
        for pdf in batches:
            for values in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                if book is not None and book.rows == SHEET_ROWS:
                    done.append((name, book.rows - 1))
                    book.close()
                    stream.close()
                    book = None
                if book is None:
                    system.create_dir(folder, recursive=True)
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{run}-{len(done)}.xlsx"
                    stream = system.open_output_stream(name)
                    book = SheetWriter(stream, cols)
                book.add(values)
        if book is not None:
            done.append((name, book.rows - 1))
            book.close()
            stream.close()
        yield pd.DataFrame(done, columns=["file", "rows"])

    written = df.mapInPandas(write, "file string, rows long").collect()  # one row per workbook
    return df.sparkSession.createDataFrame(written, "file string, rows long")
