"""Spreadsheet workbooks (Office Open XML) as rows of text.

A workbook comes as one row (path, content), which is what Spark's binary file reader gives, so it may lie in any store that Spark
reads. The sheets asked for are parsed on their own, row by row as the XML streams by; a sheet has a little over a million rows
at most. Every cell stays text and every row keeps its number in the sheet: headers are left out by number, and typing is a later step.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "path string, sheet string, row long, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BATCH = 5_000


def _column(reference: str) -> int:
    """Number of the column of a cell reference: A1 is 0, AA7 is 26."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _texts(book) -> list[str]:
    """The shared texts of a workbook; rich text runs are joined, phonetic hints are not."""
    from xml.etree.ElementTree import iterparse

    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, item in iterparse(part):
            if item.tag == MAIN + "si":
                out.append("".join(t.text or "" for t in [*item.findall(MAIN + "t"), *item.findall(f"{MAIN}r/{MAIN}t")]))
                item.clear()
    return out


def _parts(book) -> list[tuple[str, str]]:
    """(name, part of the archive) of each sheet in the order of the workbook."""
    from xml.etree.ElementTree import fromstring

    targets = {r.get("Id"): r.get("Target") for r in fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        target = targets[sheet.get(REL + "id")].lstrip("/")
        out.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def _rows(book, part: str, texts: list[str]):
    """(row number, cells) of a sheet, streamed; absent cells are None, cells after the last one are not listed."""
    from xml.etree.ElementTree import iterparse

    number = 0
    with book.open(part) as stream:
        for event, node in iterparse(stream, events=("start", "end")):
            if event == "start" or node.tag != MAIN + "row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in node.iter(MAIN + "c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = cell.find(MAIN + "v"), cell.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                elif value is not None and value.text is not None and kind != "e":
                    cells[at] = texts[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text
            node.clear()
            yield number, cells


def _parse(batches):
    import io
    import zipfile

    for batch in batches:
        for path, content, wanted in zip(batch.column("path"), batch.column("content"), batch.column("wanted")):
            book = zipfile.ZipFile(io.BytesIO(content.as_py()))
            listed, wanted = _parts(book), wanted.as_py()
            if wanted is None:
                chosen = listed
            else:
                chosen = [s for i, s in enumerate(listed) if wanted in (s[0], f"#{i + 1}")]
                if not chosen:
                    raise ValueError(f"{path} has no sheet {wanted}; it has {[n for n, _ in listed]}")
            texts = _texts(book)
            for name, part in chosen:
                block = []
                for number, cells in _rows(book, part, texts):
                    block.append((number, cells))
                    if len(block) == BATCH:
                        yield _block(path.as_py(), name, block)
                        block = []
                if block:
                    yield _block(path.as_py(), name, block)


def _block(path: str, sheet: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([path] * len(rows), pa.string()), pa.array([sheet] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()),
        pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "sheet", "row", "cells"])


def sheet_rows(files: DataFrame, sheets: list[str | int] | None = None) -> DataFrame:
    """(path, sheet, row, cells) of the workbooks ``files`` (path, content). ``sheets``: names, or numbers from 1; all by default.

    A sheet that a workbook does not have is an error, an empty one gives no rows. Error cells are NULL.
    """
    wanted: Column = F.lit(None).cast("string")
    if sheets is not None:
        wanted = F.explode(F.array(*[F.lit(f"#{s}" if isinstance(s, int) else s) for s in sheets]))
    return files.select("path", "content", wanted.alias("wanted")).mapInArrow(_parse, ROWS)


def scan_sheets(spark: SparkSession, path: str, names: list[str], sheets: list[str | int] | None = None, header_rows: int = 0) -> DataFrame:
    """Workbooks at ``path`` as text columns named by position, with sheet and row; the first ``header_rows`` rows of a sheet are left out."""
    return named_cells(sheet_rows(spark.read.format("binaryFile").load(path), sheets), names, header_rows)


def named_cells(rows: DataFrame, names: list[str], header_rows: int = 0) -> DataFrame:
    """(names..., sheet, row): cells by position; cells that a row lacks are NULL, rows without any cell are left out."""
    kept = rows.filter((F.col("row") > header_rows) & (F.size("cells") > 0))
    return kept.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "sheet", "row")


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook with the given rows per sheet: numbers as numbers, texts shared, None as no cell."""
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def letters(at: int) -> str:
        out = ""
        while at >= 0:
            out, at = chr(65 + at % 26) + out, at // 26 - 1
        return out

    texts: dict[str, int] = {}
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = f'xmlns="{MAIN[1:-1]}"'
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for i, rows in enumerate(sheets.values(), 1):
            lines = []
            for r, cells in enumerate(rows, 1):
                row = []
                for c, v in enumerate(cells):
                    if v is None:
                        continue
                    if isinstance(v, (int, float)):
                        row.append(f'<c r="{letters(c)}{r}"><v>{v!r}</v></c>')
                    else:
                        row.append(f'<c r="{letters(c)}{r}" t="s"><v>{texts.setdefault(str(v), len(texts))}</v></c>')
                lines.append(f'<row r="{r}">{"".join(row)}</row>')
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet {main}><sheetData>{"".join(lines)}</sheetData></worksheet>')
        listed = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts)
        book.writestr("xl/sharedStrings.xml", f"{head}<sst {main}>{listed}</sst>")
        named = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{kind}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        shared = f'<Relationship Id="rId0" Type="{kind}/sharedStrings" Target="sharedStrings.xml"/>'
        pack = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{links}{shared}</Relationships>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
    return out.getvalue()
