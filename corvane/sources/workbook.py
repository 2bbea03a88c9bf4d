"""Workbooks (.xlsx): review exports and what reviewers send back. One sheet, a header row, cells as text or numbers.

A workbook is made for a person, so its rows are bounded; it is written and read through Spark's file systems, so any path
that Spark can open will do.
"""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sheet has no more rows than this, the header among them (fixed by the format).
SHEET_ROWS = 1_048_576

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 2**53:
        return f"<c><v>{value!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "�", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """All rows of a table of at most `rows` rows, in its order; more are an error, as no row may be dropped silently."""
    found = df.limit(min(rows, SHEET_ROWS - 1) + 1).collect()
    if len(found) > min(rows, SHEET_ROWS - 1):
        raise ValueError(f"more than {min(rows, SHEET_ROWS - 1)} rows for a workbook")
    lines = "".join(f"<row>{''.join(_cell(v) for v in row)}</row>" for row in [df.columns, *found])
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(out.getvalue())
    finally:
        stream.close()


def sheet_reader():
    """A parser of a workbook's bytes; a closure, so that executors need not have the library."""

    def sheet_rows(content: bytes) -> list[list[str | None]]:
        """The first sheet's cells as text, inline or shared; cells that a row leaves out are null."""
        tag = lambda name: f"{{{_MAIN}}}{name}"
        text = lambda e: "".join(t.text or "" for t in e.iter(tag("t")))
        with zipfile.ZipFile(BytesIO(content)) as z:
            names = z.namelist()
            shared = [text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))] if "xl/sharedStrings.xml" in names else []
            sheet = ElementTree.fromstring(z.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
        rows = []
        for row in sheet.iter(tag("row")):
            cells: list[str | None] = []
            for c in row.iter(tag("c")):
                if name := re.match("[A-Z]+", c.get("r", "")):
                    at = 0
                    for letter in name[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (at - 1 - len(cells))
                value = c.find(tag("v"))
                kind = c.get("t")
                cells.append(text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text or 0)] if kind == "s" else value.text)
            rows.append(cells)
        return rows

    return sheet_rows


def read_workbook(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one workbook or of all that a pattern names, each parsed whole on an executor. schema: columns by their
    header; a header that is not there gives nulls, a value that does not fit its type too."""
    wanted = spark.createDataFrame([], schema).schema
    names, parse = wanted.names, sheet_reader()

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                head, *rest = parse(content.as_py()) or [[]]
                at = [head.index(n) if n in head else None for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([None if k is None or k >= len(r) else r[k] for r in rest], pa.string()) for k in at], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(cells, ", ".join(f"`{f.name}` string" for f in wanted))
    return found.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
