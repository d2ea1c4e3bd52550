"""Filling of xlsx and docx templates with records.

fill_xlsx and fill_docx make one document of all records, on the driver. fill_copies is for large
results: Spark's tasks fill a copy of the template for each range of at most max_rows records."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuseline.operators.mapping import match_headers, project
from fuseline.operators.templates import first_values, inspect, markdown_with, matched_rows
from fuseline.sources.readers import header_row, sheet_rows, word_content

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "xl/worksheets/"
_MARK = r"\{\{\s*([^{}]+?)\s*\}\}"
#: Rows that the format's sheets have.
SHEET_ROWS = 1_048_576


def _rewritten(data: bytes, parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(name, parts.get(name, old.read(name)))
    return out.getvalue()


def _letters(column: int) -> str:
    out, column = "", column + 1
    while column:
        column, k = divmod(column - 1, 26)
        out = chr(65 + k) + out
    return out


def _set(row: ET.Element, number: int, column: int, value: str) -> None:
    ref = f"{_letters(column)}{number}"
    cell = next((c for c in row if c.get("r") == ref), None)
    if cell is None:
        cell = ET.SubElement(row, _S + "c", {"r": ref})
    for child in list(cell):
        cell.remove(child)
    if re.fullmatch(r"-?\d+(?:\.\d+)?", value) and not re.match(r"-?0\d", value):
        cell.attrib.pop("t", None)
        ET.SubElement(cell, _S + "v").text = value
    else:
        cell.set("t", "inlineStr")
        ET.SubElement(ET.SubElement(cell, _S + "is"), _S + "t").text = value
    row[:] = sorted(row, key=lambda c: (len(c.get("r")), c.get("r")))


def _xlsx_headers(template: bytes) -> tuple[int, list[list[str]], list[str]]:
    """(place of the header row, rows, headers) of the first sheet."""
    _, rows = next(sheet_rows(template))
    head = header_row(rows)
    return head, rows, rows[head] if rows else []


def xlsx_with(template: bytes, names: list[str], values: list[list[str]]) -> bytes:
    """The template with values under the first sheet's headers: blank rows below them are filled
    first, in their order, then rows are added at the end; rows with text are left alone."""
    head, rows, headers = _xlsx_headers(template)
    columns = [headers.index(n) for n in names]
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        sheet = sorted(n for n in z.namelist() if n.startswith(_SHEET) and n.endswith(".xml"))[0]
        root = ET.fromstring(z.read(sheet))
    body = root.find(_S + "sheetData")
    have = {int(r.get("r") or k + 1): r for k, r in enumerate(body)}
    numbers = sorted(have)
    first = numbers[head] if numbers else 0
    filled = {n for n, r in zip(numbers, rows, strict=False) if any(r)}
    last = max(numbers, default=0)
    slots = [n for n in range(first + 1, last + 1) if n not in filled]
    if last + len(values) - len(slots) > SHEET_ROWS:
        raise ValueError(f"a sheet can't hold {len(values)} records; fill_copies writes them to many documents")
    for k, row in enumerate(values):
        n = slots[k] if k < len(slots) else last + 1 + k - len(slots)
        if n not in have:
            have[n] = ET.Element(_S + "row", {"r": str(n)})
        for column, value in zip(columns, row, strict=True):
            _set(have[n], n, column, value)
    body[:] = [have[n] for n in sorted(have)]
    return _rewritten(template, {sheet: ET.tostring(root, encoding="utf-8", xml_declaration=True)})


def _docx_placeholders(template: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return list(dict.fromkeys(name for p in root.iter(_W + "p") for name in re.findall(_MARK, "".join(t.text or "" for t in p.iter(_W + "t")))))


def _docx_headers(template: bytes) -> list[str]:
    _, tables = word_content(template)
    return tables[0][0] if tables and tables[0] else []


def docx_with(template: bytes, names: list[str], values: list[list[str]], placeholders: dict[str, str]) -> bytes:
    """The template with placeholders replaced, its first table's rows filled with values, and more
    rows added."""
    headers = _docx_headers(template)
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    for p in root.iter(_W + "p"):
        texts = list(p.iter(_W + "t"))
        whole = "".join(t.text or "" for t in texts)
        if re.search(_MARK, whole):
            for t in texts[1:]:
                t.text = ""
            texts[0].text = re.sub(_MARK, lambda m: placeholders.get(m.group(1), ""), whole)
    if headers:
        table = next(root.iter(_W + "tbl"))
        lines = table.findall(_W + "tr")
        for k, row in enumerate(values):
            line = lines[k + 1] if k + 1 < len(lines) else ET.SubElement(table, _W + "tr")
            cells = line.findall(_W + "tc")
            while len(cells) < len(headers):
                cells.append(ET.SubElement(line, _W + "tc"))
            for name, value in zip(names, row, strict=True):
                cell = cells[headers.index(name)]
                for p in cell.findall(_W + "p"):
                    cell.remove(p)
                ET.SubElement(ET.SubElement(ET.SubElement(cell, _W + "p"), _W + "r"), _W + "t").text = value
            for cell in cells:  # a cell must hold a paragraph
                if cell.find(_W + "p") is None:
                    ET.SubElement(cell, _W + "p")
    return _rewritten(template, {"word/document.xml": ET.tostring(root, encoding="utf-8", xml_declaration=True)})


def _placeholder_values(template: bytes, records: DataFrame, order: str, first: int) -> dict[str, str]:
    """Each placeholder's first different values of its column, of all records."""
    pairs = [p for name in _docx_placeholders(template) for p in match_headers([name], [c for c in records.columns if c != order])]
    return {name: first_values(records, column, order, first) for name, column, _ in pairs}


def fill_xlsx(template: bytes, records: DataFrame, order: str) -> bytes:
    """The template with all records under the first sheet's headers, as xlsx_with() puts them."""
    return xlsx_with(template, *matched_rows(records, [h for h in _xlsx_headers(template)[2] if h], order))


def fill_docx(template: bytes, records: DataFrame, order: str, first: int = 5) -> bytes:
    """The template with all records in its first table, and placeholders replaced by their column's
    first different values."""
    return docx_with(template, *matched_rows(records, [h for h in _docx_headers(template) if h], order), _placeholder_values(template, records, order, first))


def fill_copies(template: bytes, kind: str, records: DataFrame, order: str, max_rows: int = 10_000, first: int = 5) -> DataFrame:
    """range_no, copy_no, n_records and content: a copy of a template (kind xlsx, docx or markdown) for
    each at most max_rows records, filled in Spark's tasks. Copies sorted by range_no and copy_no hold
    all records in order; placeholders of docx have the same values, those of all records, in each."""
    text = inspect(template.decode(), kind) if kind == "markdown" else None
    headers = text.headers if text else _xlsx_headers(template)[2] if kind == "xlsx" else _docx_headers(template)
    pairs = match_headers([h for h in headers if h], [c for c in records.columns if c != order])
    if not pairs:
        raise ValueError(f"no column of the records matches a header of the template: {headers}")
    names = [p[0] for p in pairs]
    placeholders = _placeholder_values(template, records, order, first) if kind == "docx" else {}

    def filled(values: list[list[str]]) -> bytes:
        if kind == "docx":
            return docx_with(template, names, values, placeholders)
        return markdown_with(text, names, values).encode() if text else xlsx_with(template, names, values)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, copy, rows = TaskContext.get().partitionId(), 0, []

        def out(values: list[list[str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([copy], pa.int32()), pa.array([len(values)], pa.int32()), pa.array([filled(values)], pa.binary())], names=["range_no", "copy_no", "n_records", "content"])

        for batch in batches:
            rows += [["" if v is None else str(v) for v in r] for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            while len(rows) >= max_rows:
                yield out(rows[:max_rows])
                rows, copy = rows[max_rows:], copy + 1
        if rows:
            yield out(rows)

    ranges = records.repartitionByRange(order).sortWithinPartitions(order)
    shown = project(ranges, pairs)
    shown = shown.select(*[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.TimestampType, T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in shown.schema.fields])
    return shown.mapInArrow(fill, "range_no int, copy_no int, n_records int, content binary")
