"""Workbooks as a Spark sink: df.write.format("xlsx").mode(...).save(path), after register(spark).

Each task streams its rows into the sheets of its own workbooks, in a staging folder that all executors reach, and holds one row at a time. The
driver moves what the tasks that count have written to its place and deletes the rest, so a lost or repeated task leaves one copy
of its rows, and a failed job none. Options: max_rows, the rows of a workbook (as many as a sheet has, by default), sheet, its name."""

from __future__ import annotations

import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed: rows that a sheet has, characters that a cell holds, and the parts of the smallest workbook.
SHEET_ROWS, CELL = 1_048_576, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_BAD = {c: None for c in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF]}


def _parts(sheet: str) -> dict[str, str]:
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf") and (isinstance(value, float) or abs(value) < 1 << 53):
        return f"<c><v>{value!r}</v></c>"
    text = str(value).translate(_BAD)
    if len(text) > CELL:
        raise ValueError(f"a cell holds {CELL} characters, not {len(text)}")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(sink, names: list[str], rows: Iterator, sheet: str = "Sheet1") -> int:
    """Stream a workbook of a header and the rows to an open file; the number of rows."""
    n = 0
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _parts(sheet).items():
            z.writestr(name, _HEAD + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for row in ([names] if names else []):
                out.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            for row in rows:
                out.write(f"<row>{''.join(map(_cell, row))}</row>".encode("utf-8", "replace"))
                n += 1
            out.write(b"</sheetData></worksheet>")
    return n


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class XlsxSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema, overwrite: bool):
        out = XlsxWriter(dict(self.options), [f.name for f in schema.fields], overwrite)
        # the driver makes the folder, not the tasks: one that is still at work when the job is given up can't make it again
        store, folder = _store(out.path)
        store.create_dir(f"{folder}/{out.staging}", recursive=True)
        return out


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.max_rows, self.sheet = int(options.get("max_rows", SHEET_ROWS - 1)), options.get("sheet", "Sheet1")
        if not 1 <= self.max_rows < SHEET_ROWS:
            raise ValueError(f"max_rows must be from 1 to {SHEET_ROWS - 1}")
        self.job = uuid.uuid4().hex
        self.staging = f"_staging-{self.job}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        task, out, rows = TaskContext.get(), Written(), iter(iterator)
        store, folder = _store(self.path)
        first = next(rows, None)
        while first is not None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(out.files):03d}-{self.job}.xlsx"
            part = _few(first, rows, self.max_rows)
            with store.open_output_stream(f"{folder}/{self.staging}/{name}") as sink:
                out.rows += write_workbook(sink, self.names, part, self.sheet)
            out.files.append(name)
            first = next(rows, None)
        return out

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        before = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-") and f.base_name.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{folder}/{self.staging}/{name}", f"{folder}/{name}")
        for path in before:
            store.delete_file(path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        for left in range(4, -1, -1):
            if store.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(f"{folder}/{self.staging}")
            except OSError:  # a task that was still at work put a file there meanwhile
                if not left:
                    raise
                time.sleep(0.2)


def _few(first, rows: Iterator, most: int) -> Iterator:
    """first and at most most - 1 of the rows; the others stay."""
    yield first
    for _ in range(most - 1):
        row = next(rows, None)
        if row is None:
            return
        yield row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSink)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no (from 0, the header) and cells of the first sheets of the workbooks in a folder; tasks read a workbook at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fuseline.sources.readers import sheet_rows

        for batch in batches:
            for name, content in zip(*(batch.column(c) for c in ("path", "content")), strict=True):
                _, rows = next(sheet_rows(content.as_py()))
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    yield pa.RecordBatch.from_pydict({"file": [name.as_py()] * len(part), "row_no": pa.array(range(k, k + len(part)), pa.int64()), "cells": pa.array(part, pa.list_(pa.string()))})

    return files.mapInArrow(read, "file string, row_no long, cells array<string>")
