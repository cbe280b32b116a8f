"""Workbooks and typed text."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from panelweave.sources import sheets as SH, tables as IO


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    rows = [["code", "value"], [None, "unit"], ["0101", 1.5], ["01 & <2>", "-"], [7, "n/a", None, "late"], [], [" é ", 1e-9]]
    for k in range(3):
        (folder / f"b{k}.xlsx").write_bytes(SH.workbook({"first": [[k]], "Data 2": rows, "empty": []}))
    return str(folder)


def test_sheets_by_name_and_number(spark, books):
    named = SH.scan_sheets(spark, books, ["code", "value", "c", "d"], ["Data 2"], header_rows=2)
    numbered = SH.scan_sheets(spark, books, ["code", "value", "c", "d"], [2], header_rows=2)
    want = sorted([("0101", "1.5", None, None, 3), ("01 & <2>", "-", None, None, 4), ("7", "n/a", None, "late", 5), (" é ", "1e-09", None, None, 7)] * 3, key=str)
    for df in (named, numbered):
        assert sorted(((r.code, r.value, r.c, r.d, r.row) for r in df.collect()), key=str) == want
    whole = SH.sheet_rows(spark.read.format("binaryFile").load(books))
    assert {r.sheet: r.n for r in whole.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).collect()} == {"first": 3, "Data 2": 21}
    assert SH.scan_sheets(spark, books, ["a"], ["empty"]).count() == 0
    with pytest.raises(Exception, match="has no sheet"):
        SH.scan_sheets(spark, books, ["a"], ["none"]).collect()


def test_texts_that_do_not_parse_are_named(spark, books):
    raw = SH.scan_sheets(spark, books, ["code", "value"], ["Data 2"], header_rows=2).select("code", "value")
    out = IO.typed(raw, {"code": "int", "value": "double"}, failed="failed").distinct().collect()
    assert {(r.code, r.value, r.failed) for r in out} == {(101, 1.5, ""), (None, None, "code"), (7, None, "value"), (None, 1e-9, "code")}


def test_other_kinds_of_cells(spark, tmp_path):
    """Inline and rich texts, truth values, errors, formula texts, rows and cells without a reference."""
    blob = io.BytesIO()
    main, rel = SH.MAIN[1:-1], SH.REL[1:-1]
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="x" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>in</t></is></c><c t="s"><v>0</v></c><c t="b"><v>1</v></c></row>'
                   '<row r="9"><c r="AB9" t="str"><v>far</v></c></row><row r="10"><c r="A10" t="e"><v>#N/A</v></c><c r="C10"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "k.xlsx").write_bytes(blob.getvalue())
    rows = {r.row: r.cells for r in SH.sheet_rows(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows == {1: ["in", "rich", "TRUE"], 9: [None] * 27 + ["far"], 10: [None, None, "3"]}


def test_a_long_report_is_not_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "REPORT_ROWS", 5)
    IO.write_csv(spark.range(5), str(tmp_path / "a"), ["id"], single_file=True)
    with pytest.raises(ValueError, match="several files"):
        IO.write_csv(spark.range(6), str(tmp_path / "b"), ["id"], single_file=True)


def test_refresh_replaces_whole_partitions(spark, tmp_path, monkeypatch):
    from panelweave.sources import snapshots as SN

    path = str(tmp_path / "snap")
    rows = [(p, k, f"{p}-{k}") for p in (1, 2, 3) for k in range(4)]
    first = spark.createDataFrame(rows, "period int, k int, v string")
    assert SN.refresh_snapshot(first, path, ["period"], "one") == 1
    kept = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "snap/one").rglob("*.parquet") if "period=2" not in str(f)}
    other = spark.createDataFrame([(2, 9, "new"), (7, 0, "added")], "period int, k int, v string")
    # a refresh that dies before its manifest is not seen
    with monkeypatch.context() as m:
        m.setattr(SN, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            SN.refresh_snapshot(other, path, ["period"], "two")
    read = lambda: sorted((r.period, r.k, r.v) for r in SN.read_refreshed(spark, path).collect())
    assert read() == sorted(rows)
    assert SN.refresh_snapshot(other, path, ["period"], "two") == SN.refresh_snapshot(other, path, ["period"], "two") == 2
    want = sorted([r for r in rows if r[0] != 2] + [(2, 9, "new"), (7, 0, "added")])
    assert read() == want
    assert kept == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "snap/one").rglob("*.parquet") if "period=2" not in str(f)}
    assert SN.refresh_snapshot(other.limit(0), path, ["period"], "none") == 3 and read() == want
    # two refreshes from the same state: the later one is refused and may run again
    stale = SN.manifest_of(spark, path) | {"number": 3, "refreshes": ["x"]}
    with pytest.raises(RuntimeError, match="again"):
        SN._commit(spark, path, stale)
    assert SN.drop_unused(spark, path) == 1 and read() == want and not (tmp_path / "snap/one/period=2").exists()
