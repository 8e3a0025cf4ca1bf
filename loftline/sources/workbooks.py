"""Sheets of workbooks (Office Open XML), one task a workbook.

Files come as Spark's ``binaryFile`` reads them, so they can lie in any store that Spark
reads.  A workbook is taken apart on an executor, with the standard library alone; its
cells come out as text, as a sheet shows them without formats.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ROWS = "file string, sheet string, row int, cells array<string>"


def workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """``path`` and ``content`` of the workbooks of a folder or file; each is a row, and so a unit of work."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def _column(reference: str) -> int:
    """Place of a cell, from 0: 'A1' is 0, 'AB7' is 27."""
    at = 0
    for letter in reference.rstrip("0123456789"):
        at = at * 26 + ord(letter.upper()) - 64
    return at - 1


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, without their phonetic notes."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _number(text: str) -> str:
    """Whole numbers without the trailing zero that some writers leave."""
    return text[:-2] if re.fullmatch(r"-?\d+\.0", text) else text


def _cell(cell: ElementTree.Element, strings: Sequence[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        held = cell.find(f"{_MAIN}is")
        return _text(held) if held is not None else None
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return _number(value.text) if kind == "n" else value.text


def sheets_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number (from 0, as the sheet counts) and cells of every row of a workbook that has a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            at = 0
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                # Rows are let go as they are read, so a long sheet isn't held as a tree.
                for _, node in ElementTree.iterparse(part):
                    if node.tag != f"{_MAIN}row":
                        continue
                    at = int(node.get("r", at + 1))
                    cells: dict[int, str | None] = {}
                    for k, cell in enumerate(node.iter(f"{_MAIN}c")):
                        cells[_column(cell.get("r")) if cell.get("r") else k] = _cell(cell, strings)
                    node.clear()
                    if any(v not in (None, "") for v in cells.values()):
                        yield sheet.get("name"), at - 1, [cells.get(k) or None for k in range(max(cells) + 1)]


def cells(files: DataFrame) -> DataFrame:
    """file, sheet, row and cells of all rows of workbooks (path, content)."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held: list[tuple] = []
                for row in sheets_of(content.as_py()):
                    held.append((path, *row))
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["file", "sheet", "row", "cells"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["file", "sheet", "row", "cells"])

    return files.select("path", "content").mapInArrow(take_apart, _ROWS)


def sheet_rows(files: DataFrame, columns: Mapping[str, str | int], header: int = 0, sheet: str | None = None, key: str | None = None, skip: int = 0) -> DataFrame:
    """Rows under a header row as text columns, with ``file``, ``sheet`` and ``row``.

    ``columns`` gives each wanted column its header (compared in lower case, with runs of
    blanks, hyphens and line breaks as one blank) or its place.  Rows above ``header`` are titles.
    Without the ``key`` column a row is a footnote and is dropped.  ``skip`` drops the first
    so many rows of each sheet that have all ``columns``; with it, rows that lack one are
    dropped as well.  A sheet that lacks a header named has nulls there.
    """
    every = cells(files)
    every = every if sheet is None else every.where(F.col("sheet") == sheet)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\-]+", " "))
    heads = every.where(F.col("row") == header).select("file", "sheet", F.transform("cells", plain).alias("_heads"))
    body = every.where(F.col("row") > header).join(heads, ["file", "sheet"])
    place = lambda c: F.lit(c + 1) if isinstance(c, int) else F.array_position(F.col("_heads"), c.lower()).cast("int")
    picked = {n: F.when(place(c) > 0, F.get("cells", place(c) - 1)) for n, c in columns.items()}
    out = body.select("file", "sheet", "row", *[c.alias(n) for n, c in picked.items()])
    if key:
        out = out.where(F.col(key).isNotNull())
    if skip:
        out = out.na.drop(subset=list(columns))
        # The format ends a sheet at 1,048,576 rows, so no sheet is too long for one window.
        place_in_sheet = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row"))
        out = out.withColumn("_k", place_in_sheet).where(F.col("_k") > skip).drop("_k")
    return out


def _cell_xml(at: int, row: int, value: object) -> str:
    letters, k = "", at + 1
    while k:
        k, rest = divmod(k - 1, 26)
        letters = chr(65 + rest) + letters
    place = f'r="{letters}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {place} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {place}><v>{value!r}</v></c>"
    shown = str(value).replace("&", "&amp;").replace("<", "&lt;")
    return f'<c {place} t="inlineStr"><is><t xml:space="preserve">{shown}</t></is></c>'


def workbook(sheets: Mapping[str, Sequence[Sequence[object]]]) -> bytes:
    """A plain workbook of these rows by sheet; a null row is left out."""
    out, kind = io.BytesIO(), "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">' + "".join(_cell_xml(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if row is not None)
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()
