"""Readers of files, databases, pages and streams."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from fuseline.operators import office, store, templates
from fuseline.sources import database, loader, readers
from fuseline.streaming.counters import event_counters, import_stream


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name;Age;City\nAnn; 3 ;X\n;;\nBob;4;Y\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Name", "Age", "City"]
    assert [tuple(r) for r in df.collect()] == [("Ann", "3", "X"), ("Bob", "4", "Y")]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"a": {"b": 1, "c": {"d": {"e": 2}}}, "l": [1, 2]}, {"l": []}]}))
    df = readers.read_json(spark, str(tmp_path / "a.json"))
    assert df.columns == ["a.b", "a.c.d.e", "l"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "1；2"), (None, None, "")]


def test_text_and_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nText.\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n")
    blocks = readers.read_blocks(spark, str(tmp_path / "a.md")).orderBy("block_index").collect()
    assert [(b["content"].split("\n")[0], b["heading_level"]) for b in blocks] == [("# Title", 1), ("Text.", 0), ("| A | B |", 0)]
    cells = readers.markdown_cells(spark, str(tmp_path / "a.md")).orderBy("row_id", "col_index").collect()
    assert [(c["row_id"], c["header"], c["value"]) for c in cells] == [(0, "A", "1"), (0, "B", "2"), (1, "A", "3"), (1, "B", "4")]
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    assert [r["content"] for r in readers.read_blocks(spark, str(tmp_path / "b.txt")).orderBy("block_index").collect()] == ["one", "two"]


def test_office(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Name</t></si><si><t>Value</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    cells = readers.office_cells(spark, str(tmp_path / "a.xlsx")).orderBy("col_index").collect()
    assert [(c["header"], c["value"]) for c in cells] == [("Name", ""), ("Value", "5")]
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr>{cell("H")}{cell("I")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>')
    assert [(r["content"], r["heading_level"]) for r in readers.word_blocks(spark, str(tmp_path / "a.docx")).collect()] == [("Top", 2), ("Body", 0)]
    assert readers.office_cells(spark, str(tmp_path / "a.docx")).count() == 2


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "<h1>x</h1><table><tr><th>City</th><th>GDP</th></tr><tr><td>A</td><td>1</td></tr><tr><td>B</td><td>2</td></tr></table>"), (2, None)], "page_id int, html string")
    cells = readers.page_cells(pages).orderBy("row_id", "col_index").collect()
    assert [(c["header"], c["value"]) for c in cells] == [("City", "A"), ("GDP", "1"), ("City", "B"), ("GDP", "2")]


def test_page_headings_are_their_sql(spark, tmp_path):
    """References cut short or other than the SQL's three, no heading, two of them, no page."""
    import duckdb

    from fuseline.plans import catalogue

    heads = ["<h1>a &amp; b&amp</h1>", "<h1>token = &quot;0b&copy; &lt;i&gt;</h1>", "<h1>&amp;lt; &amp;amp; &#65;&nbsp;&</h1>", "<p>none</p>", "<h1> one </h1><h1>two</h1>", "", None]
    rows = [(i, f"u{i}", h and f"<html><head><title>t</title></head><body>{h}<p>&amp; &quot;x&quot;</p></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.sql(catalogue.oracle_sql()["page_headings"]).fetchall())
    assert sorted(map(tuple, catalogue.queries()["page_headings"](spark, str(tmp_path)).collect())) == want
    assert [r["content"] for r in readers.page_blocks(spark.read.parquet(f"{tmp_path}/pages.parquet").filter("page_id = 1")).collect()] == ['token = "0b© <i>', '& "x"']


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE items(name TEXT, amount REAL, id INTEGER)")
        db.executemany("INSERT INTO items VALUES (?, ?, ?)", [("x", 1.5, k) for k in range(10)])
    database.register(spark)
    read = spark.read.format("sqlite_query").option("path", path).option("query", "select * from items")
    assert read.load().columns == ["name", "amount", "id"]
    parts = read.option("partition_column", "id").option("lower", "0").option("upper", "9").option("partitions", "3").load()
    assert parts.count() == 10 and parts.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="http"):
        spark.read.format("http_get").option("urls", "file:///etc/hosts").load().count()


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "北京市人民 华为技术公司"), (2, "same"), (3, "same")], "doc_id long, text string")
    root = str(tmp_path / "store")
    assert [r["doc_id"] for r in store.import_batch(docs, root, "1").orderBy("doc_id").collect()] == [1, 2]
    assert store.import_batch(docs, root, "2").count() == 0
    found = {(r["entity_text"], r["entity_type"]) for r in spark.read.parquet(f"{root}/extracted_entities").collect()}
    assert ("北京市", "location") in found and ("华为技术公司", "organization") in found
    all_ = spark.read.parquet(f"{root}/documents")
    assert store.delete_documents(all_, docs.filter("doc_id = 1")).count() == 1
    assert store.export_package({"documents": all_.select("doc_id", "text")}, 2).first()["rows"] is not None
    assert store.upsert(docs, docs.limit(1), "doc_id").count() == 3
    assert store.source_catalog(spark).count() == 4


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in" / "e"))
    stream = event_counters(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e")))
    q = stream.writeStream.format("memory").queryName("counters").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = event_counters(spark.read.parquet(f"{data}/events.parquet"))
    assert spark.table("counters").agg(F.sum("n_events")).first() == batch.agg(F.sum("n_events")).first()
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    q = import_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "s"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "documents")).count() == 2


def test_loader_goes_on_after_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    sources = [loader.Source("file", str(tmp_path / "a.csv")), loader.Source("file", str(tmp_path / "none.json")), loader.Source("file", "x.bin"), loader.Source("odd", "y")]
    good, bad = loader.load_all(spark, sources)
    assert list(good) == [str(tmp_path / "a.csv")] and len(bad) == 3
    shown = {r["status"]: r for r in loader.preview(spark, sources[:1] + sources[2:3]).collect()}
    assert shown["ok"]["columns"] == ["x", "y"] and '"1"' in shown["ok"]["sample"] and "ending" in shown["error"]["sample"]


def test_fill_xlsx(spark, tmp_path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        inline = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1">{inline("A1", "Name")}{inline("B1", "Value")}</row><row r="2"/><row r="3">{inline("A3", "KEEP")}</row><row r="4"/></sheetData></worksheet>')
    records = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", None)], "n int, name string, value int")
    out = office.fill_xlsx((tmp_path / "t.xlsx").read_bytes(), records.withColumnsRenamed({"name": "Name", "value": "Value"}), "n")
    (_, rows), = readers.sheet_rows(out)
    assert rows == [["Name", "Value"], ["a", "5"], ["KEEP"], ["b", "6"], ["c", ""]]


def test_fill_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:r><w:t>For {{{{ci</w:t></w:r><w:r><w:t>ty}}}}.</w:t></w:r></w:p><w:tbl><w:tr>{cell("city")}{cell("gdp")}</w:tr><w:tr>{cell("")}{cell("")}</w:tr></w:tbl></w:body></w:document>')
    records = spark.createDataFrame([(1, "A", 5), (2, "B", 6)], "n int, city string, gdp int")
    paragraphs, tables = readers.word_content(office.fill_docx((tmp_path / "t.docx").read_bytes(), records, "n"))
    assert paragraphs == [("For A；B.", 0)] and tables == [[["city", "gdp"], ["A", "5"], ["B", "6"]]]


def small_templates():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    parts = {
        "xlsx": {
            "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>city</t></is></c><c r="B1" t="inlineStr"><is><t>gdp</t></is></c></row></sheetData></worksheet>',
        },
        "docx": {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Note: {{{{note}}}}</w:t></w:r></w:p><w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>" for t in ("city", "gdp")) + "</w:tr></w:tbl></w:body></w:document>"},
    }
    out = {"markdown": b"| city | gdp |\n| - | - |\nend"}
    for kind, files in parts.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        out[kind] = data.getvalue()
    return out


def test_templates_take_all_records(spark):
    files = small_templates()
    records = spark.range(10_005).selectExpr("id AS n", "concat('c', id) AS city", "id * 2 AS gdp", "IF(id = 10004, 'late', NULL) AS note")
    want = [["city", "gdp"], *[[f"c{i}", str(2 * i)] for i in range(10_005)]]
    (_, rows), = readers.sheet_rows(office.fill_xlsx(files["xlsx"], records, "n"))
    assert rows == want
    paragraphs, tables = readers.word_content(office.fill_docx(files["docx"], records, "n"))
    assert paragraphs == [("Note: late", 0)] and tables == [want]
    markdown = templates.fill_markdown(templates.inspect(files["markdown"].decode(), "markdown"), records.limit(2000), "n")
    assert len(markdown.splitlines()) == 2003 and "| c1999 | 3998 |" in markdown


def test_fill_copies(spark):
    files = small_templates()
    records = spark.range(1000).repartition(7).selectExpr("id AS n", "concat('c', id) AS city", "IF(id % 2 = 0, id, NULL) AS gdp", "IF(id = 999, 'late', NULL) AS note")
    want = [[f"c{i}", str(i) if i % 2 == 0 else ""] for i in range(1000)]
    for kind in files:
        copies = sorted(office.fill_copies(files[kind], kind, records, "n", max_rows=90).collect(), key=lambda r: (r["range_no"], r["copy_no"]))
        assert len(copies) >= 12 and max(r["n_records"] for r in copies) <= 90 and sum(r["n_records"] for r in copies) == 1000
        got = []
        for r in copies:
            data = bytes(r["content"])
            if kind == "xlsx":
                (_, rows), = readers.sheet_rows(data)
            elif kind == "docx":
                paragraphs, (rows,) = readers.word_content(data)
                assert paragraphs == [("Note: late", 0)]
            else:
                rows = [[], *[[c.strip() for c in line.split("|")[1:-1]] for line in data.decode().splitlines()[2:-1]]]
            got += rows[1:]
        assert got == want
    with pytest.raises(ValueError, match="no column"):
        office.fill_copies(files["xlsx"], "xlsx", records.selectExpr("n", "n AS zzz"), "n")
