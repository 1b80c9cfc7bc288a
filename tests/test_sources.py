import os

from tabscope.sources import delimited, tables, workbook


def test_delimiters_and_turkish_encoding(spark, tmp_path):
    for sep, name in [(";", "a.csv"), ("|", "b.csv"), ("\t", "c.tsv")]:
        p = tmp_path / name
        p.write_text(sep.join(["id", "city", "amount"]) + "\n" + "\n".join(
            sep.join([str(i), "Ankara", str(i * 2)]) for i in range(10)) + "\n", encoding="utf-8")
        meta = delimited.detect_csv(spark, str(p), tsv=name.endswith(".tsv"))
        assert meta["delimiter"] == sep
        df = tables.read_table(spark, str(p))
        assert df.columns == ["id", "city", "amount"] and df.count() == 10
    p = tmp_path / "tr.csv"
    p.write_bytes("ad;şehir\nŞükrü;İzmir\nAyşe;Muğla\n".encode("cp1254"))
    meta = delimited.detect_csv(spark, str(p))
    assert meta == {"encoding": "windows-1254", "delimiter": ";"}
    rows = tables.read_table(spark, str(p)).collect()
    assert rows[0]["ad"] == "Şükrü"


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id long, name string, x double")
    out = str(tmp_path / "wb")
    workbook.write_workbooks(df.coalesce(1), out)
    assert any(f.endswith(".xlsx") for f in os.listdir(out))
    back = tables.read_table(spark, out, fmt="xlsx").orderBy("id").collect()
    assert [(r["id"], r["name"], r["x"]) for r in back] == [(1, "a", 1.5), (2, "b", None)]


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    res = {(r["check"], r["column_name"]): r["n_bad"] for r in
           tables.checks(df, required=["k", "zz"], not_null=["v"], unique=["k"]).collect()}
    assert res[("required", "zz")] == 1 and res[("not_null", "v")] == 1 and res[("unique", "k")] == 1


def test_formats_are_detected_by_file_and_over_all_lines(spark, tmp_path):
    late, semi, comma = tmp_path / "late.csv", tmp_path / "semi.csv", tmp_path / "comma.csv"
    late.write_bytes(("id;city\n" + "".join(f"{i};Ankara\n" for i in range(400)) + "400;Muğla Şişli\n").encode("cp1254"))
    semi.write_text("id;v\n1;2\n3;4\n")
    comma.write_text("id,v\n5,6\n")
    rows = {r["id"]: r["city"] for r in delimited.read_delimited(spark, str(late)).collect()}
    assert len(rows) == 401 and rows[400] == "Muğla Şişli"
    both = delimited.read_delimited(spark, [str(semi), str(comma)])
    assert sorted((r["id"], r["v"]) for r in both.collect()) == [(1, 2), (3, 4), (5, 6)]
    found = {r["file"].rsplit("/", 1)[1]: (r["encoding"], r["delimiter"]) for r in
             delimited.detect_files(spark, [str(late), str(semi), str(comma)]).collect()}
    assert found == {"late.csv": ("windows-1254", ";"), "semi.csv": ("UTF-8", ";"), "comma.csv": ("UTF-8", ",")}
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert delimited.detect_csv(spark, str(empty)) == {"encoding": "UTF-8", "delimiter": ","}


def _tricky_rows(n):
    """Fields with delimiters, quotes, line breaks and blank lines inside."""
    texts = ["plain", 'say "hi"', "a;b;c", "two\nlines", "three\n\nlines; with \"quotes\"\nand more", "", "5\" pipe", "end\n", ";;;;;", "ö\nş"]
    return [[str(i), texts[i % len(texts)], str(i * 2.5)] for i in range(n)]


def test_quoted_delimiters_and_line_breaks_over_many_pieces(spark, tmp_path):
    import csv

    files = []
    for name, cols, n in (("one.csv", ["id", "note", "x"], 400), ("two.csv", ["id", "note", "x", "extra"], 60)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as fh:
            writer = csv.writer(fh, delimiter=";", lineterminator="\n")
            writer.writerow(cols)
            writer.writerows(r + ["e"] * (len(cols) - 3) for r in _tricky_rows(n))
        files.append(str(tmp_path / name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")  # records cross the pieces of a file
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = {r["file"].rsplit("/", 1)[1]: (r["encoding"], r["delimiter"], r["crosses"]) for r in delimited.detect_files(spark, files).collect()}
        assert found == {"one.csv": ("UTF-8", ";", True), "two.csv": ("UTF-8", ";", True)}
        df = delimited.read_delimited(spark, files)
        assert dict(df.dtypes)["id"] == "int" and dict(df.dtypes)["x"] == "double"
        got = sorted(((r["id"], r["note"] or "", r["x"], r["extra"]) for r in df.collect()), key=lambda r: (r[3] or "", r[0]))
        want = [(int(a), b, float(c), None) for a, b, c in _tricky_rows(400)] + [(int(a), b, float(c), "e") for a, b, c in _tricky_rows(60)]
        assert got == want
        meta = {r["file_name"]: (r["rows"], r["suffix"]) for r in delimited.delimited_meta(spark, files).collect()}
        assert meta == {"one.csv": (400, ".csv"), "two.csv": (60, ".csv")}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quotes_do_not_count_and_settings_are_restored(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,note\n' + "".join(f'{i},"a;b;c, d"\n' for i in range(20)) + '20,5" pipe\n')
    rows = delimited.read_delimited(spark, str(p)).orderBy("id").collect()
    assert len(rows) == 21 and rows[0]["note"] == "a;b;c, d" and rows[20]["note"] == '5" pipe'
    latin = tmp_path / "l.csv"
    latin.write_bytes('ad;not\nŞükrü;"iki\nsatır"\n'.encode("cp1254"))
    row = delimited.read_delimited(spark, str(latin)).first()
    assert (row["ad"], row["not"]) == ("Şükrü", "iki\nsatır")
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    open_ = tmp_path / "open.csv"
    open_.write_text('a,b\n1,"never closed\n2,3\n')
    assert [tuple(r) for r in delimited.read_delimited(spark, str(open_)).collect()][0][0] == 1


def test_workbooks_of_different_headers_sheets_and_errors(spark, tmp_path, monkeypatch):
    import pytest

    folder = str(tmp_path / "mixed")
    workbook.write_workbooks(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string").coalesce(1), folder)
    workbook.write_workbooks(spark.createDataFrame([("b", 3, 1.5)], "name string, id long, extra double").coalesce(1), folder)
    rows = {(r["id"], r["name"], r["extra"]) for r in tables.read_table(spark, folder, fmt="xlsx").collect()}
    assert rows == {(1, "a", None), (2, None, None), (3, "b", 1.5)}
    meta = workbook.workbook_meta(spark, folder).collect()
    assert {(r["rows"], r["columns"], r["selected_sheet"], tuple(r["sheets"]), r["suffix"]) for r in meta} == {(2, 2, "data", ("data",), ".xlsx"), (1, 3, "data", ("data",), ".xlsx")}
    assert tables.read_table(spark, folder, fmt="xlsx", sheet="data").count() == 3
    for bad in ("other", 1):
        with pytest.raises(tables.LoadError):
            tables.read_table(spark, folder, fmt="xlsx", sheet=bad)
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    for name, options in (("broken.xlsx", {}), ("empty.csv", {}), ("head.csv", {}), ("missing.csv", {}), ("missing.parquet", {}), ("t.csv", {"encoding": "no-such-page"}),
                          ("x.doc", {}), ("old.xls", {})):
        with pytest.raises(tables.LoadError):
            tables.read_table(spark, str(tmp_path / name), **options)
    assert tables.read_table(spark, str(tmp_path / "head.csv"), allow_empty=True).columns == ["a", "b"]


def test_large_partitions_give_several_workbooks(spark, tmp_path):
    import io

    buffer = io.BytesIO()
    book = workbook.SheetWriter(buffer, ["a", "b"])
    for i in range(5000):
        book.add((i, f"<{i}> & é"))
    book.close()
    rows = list(workbook.sheet_rows(buffer.getvalue()))
    assert len(rows) == 5001 and rows[0][3] == ["a", "b"] and rows[5000] == ("data", 0, 5000, ["4999", "<4999> & é"])
