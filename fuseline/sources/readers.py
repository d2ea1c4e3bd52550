"""Readers of files into rows of text, cells and blocks.

Homogeneous folders go through Spark's own readers, which split large files. Office files and HTML
tables are parsed one file at a time in mapInPandas over binaryFile, in as many tasks as files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "path string, table_index int, sheet string, row_id int, col_index int, header string, value string"
BLOCKS = "path string, block_index int, content string, heading_level int"
MAX_SNIFF = 4096


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:MAX_SNIFF], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with a header, every column as text; blank rows are dropped."""
    if delimiter is None:
        first = spark.read.text(path).limit(20).collect()
        delimiter = sniff_delimiter("\n".join(r[0] for r in first))
    df = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.dropna("all")


def flatten_json(df: DataFrame, depth: int = 3, joiner: str = "；", most: int | None = None) -> DataFrame:
    """Nested columns as dotted ones: structs to the given depth, arrays of plain values joined (all of
    them, or the first most), anything deeper as JSON text."""
    out: list[Column] = []

    def walk(c: Column, name: str, kind: T.DataType, left: int) -> None:
        if isinstance(kind, T.StructType) and left > 0:
            for f in kind.fields:
                walk(c.getField(f.name), f"{name}.{f.name}" if name else f.name, f.dataType, left - 1)
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.concat_ws(joiner, (c if most is None else F.slice(c, 1, most)).cast("array<string>")).alias(name))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(name))
        else:
            out.append(c.cast("string").alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType, depth)
    return df.select(*out)


def read_json(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """A JSON file whose root is a list of objects or an object with such a list; flattened."""
    df = spark.read.json(path, multiLine=True)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists:
        df = df.select(F.explode(f"`{lists[0]}`").alias("row")).select("row.*")
    return flatten_json(df, depth)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, block_index, content, heading_level of text or Markdown files."""
    from fuseline.operators.narrative import blocks

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return blocks(files).withColumnRenamed("doc_id", "path")


def markdown_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the pipe tables in Markdown files, as DataFrame operations on their lines."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rows = lines.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    parts = F.transform(F.split(F.regexp_extract("line", r"^\s*\|(.*)\|\s*$", 1), r"\|"), lambda x: F.trim(x))
    marks = lines.filter(F.col("line").rlike(r"^\s*\|[\s|:-]+\|\s*$")).select("path", (F.col("n") - 1).alias("head"))
    tables = rows.join(marks, "path").filter(F.col("n") >= F.col("head")).groupBy("path", "n", parts.alias("parts")).agg(F.max("head").alias("head"))
    heads = tables.filter("n = head").select("path", "head", F.col("parts").alias("headers"))
    body = tables.filter("n > head").join(heads, ["path", "head"])
    out = body.select("path", "head", (F.col("n") - F.col("head") - 2).cast("int").alias("row_id"), "headers", F.posexplode("parts").alias("col_index", "value"))
    return out.select("path", F.col("head").alias("table_index"), "row_id", "col_index", F.get("headers", F.col("col_index")).alias("header"), "value")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of text) of each sheet of an xlsx file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + links[sheet.get(_R + "id")].lstrip("/").removeprefix("xl/"))).iter(_S + "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(_S + "c")):
                    v, inline = c.find(_S + "v"), c.find(_S + "is")
                    text = "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else (v.text or "") if v is not None else ""
                    cells[_column_number(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append([cells.get(k, "").strip() for k in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def header_row(rows: list[list[str]]) -> int:
    """The first of five rows with at least two filled cells, else the first."""
    return next((k for k, r in enumerate(rows[:5]) if sum(bool(c) for c in r) >= 2), 0)


def word_content(data: bytes) -> tuple[list[tuple[str, int]], list[list[list[str]]]]:
    """([(paragraph, heading level)], tables as rows of text) of a docx file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t")).strip()
    paragraphs = []
    for p in body.findall(_W + "p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.search(r"(\d)", style.get(_W + "val")) if style is not None and "eading" in style.get(_W + "val") else None
        if text(p):
            paragraphs.append((text(p), int(level.group(1)) if level else 0))
    return paragraphs, [[[text(c) for c in r.findall(_W + "tc")] for r in t.findall(_W + "tr")] for t in body.findall(_W + "tbl")]


#: Fixed: elements that hold a block of a page's text, and those whose text isn't shown.
_BLOCKS = ("p", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dt", "dd")
_UNSEEN = ("script", "style", "noscript", "head", "template")


class _Blocks(HTMLParser):
    """blocks: (text, heading level or 0) of the page in order, tables left out; title."""

    def __init__(self):
        super().__init__()
        self.blocks: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.level = self.unseen = self.tables = 0
        self.title: list[str] = []
        self.in_title = False

    def _cut(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.blocks.append((text, self.level))
        self.text, self.level = [], 0

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title"
        self.unseen += tag in _UNSEEN
        self.tables += tag == "table"
        if tag in _BLOCKS or tag in ("div", "table", "ul", "ol"):
            self._cut()
            self.level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0

    def handle_endtag(self, tag):
        self.in_title = False
        self.unseen -= tag in _UNSEEN and self.unseen > 0
        if tag == "table" and self.tables:
            self.tables -= 1
        if tag in _BLOCKS or tag in ("div", "body", "html"):
            self._cut()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.unseen and not self.tables:
            self.text.append(data)


def html_blocks(html: str | None) -> list[tuple[str, int]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._cut()
    return parser.blocks


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.text: list[str] | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.text = []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript") and self.skip > 0
        if tag in ("td", "th") and self.text is not None:
            self.tables[-1][-1].append(" ".join("".join(self.text).split()))
            self.text = None

    def handle_data(self, data):
        if self.text is not None and not self.skip:
            self.text.append(data)


def html_tables(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    return [[r for r in t if r] for t in parser.tables]


def _cells(path: str, index: int, sheet: str, rows: list[list[str]]) -> list[tuple]:
    if not rows:
        return []
    at = header_row(rows)
    heads, body = rows[at], [r for r in rows[at + 1 :] if any(r)]
    return [(path, index, sheet, i, j, heads[j] if j < len(heads) else "", v) for i, r in enumerate(body) for j, v in enumerate(r)]


def office_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of xlsx sheets and docx tables below path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if name.endswith(".xlsx"):
                    tables = list(sheet_rows(data))
                elif name.endswith(".docx"):
                    tables = [("", t) for t in word_content(data)[1]]
                else:
                    tables = []
                rows = [c for k, (sheet, t) in enumerate(tables) for c in _cells(name, k, sheet, t)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def word_blocks(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, k, t, level) for k, (t, level) in enumerate(word_content(data)[0])]
                yield pd.DataFrame(rows, columns=["path", "block_index", "content", "heading_level"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, BLOCKS)


def page_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_index, row_id, col_index, header, value of the HTML tables of pages."""

    @F.pandas_udf("array<struct<table_index:int,row_id:int,col_index:int,header:string,value:string>>")
    def parse(html: pd.Series) -> pd.Series:
        out = [[dict(zip(("table_index", "row_id", "col_index", "header", "value"), (c[1], *c[3:]), strict=True)) for k, t in enumerate(html_tables(h)) for c in _cells("", k, "", t)] for h in html]
        return pd.Series(out)

    return pages.select("page_id", F.inline(parse("html")))


def block_list(html: Column) -> Column:
    """The blocks of a page's text in order, as an array of content and heading_level."""
    shape = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("heading_level", T.IntegerType())]))

    @F.arrow_udf(shape)
    def parse(html: pa.Array) -> pa.Array:
        out = [[{"content": t, "heading_level": level} for t, level in html_blocks(h.as_py())] for h in html]
        return pa.array(out, pa.list_(pa.struct([("content", pa.string()), ("heading_level", pa.int32())])))

    return parse(html)


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_index, content, heading_level of the text of pages."""
    return pages.select("page_id", F.posexplode(block_list(F.col("html"))).alias("block_index", "b")).select("page_id", "block_index", "b.*")


def page_titles(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id and title: each page's first heading of level 1, "" if it has none, null if it has no html. references:
    the only character references that are decoded, and only with their semicolon; others stay as they are written."""
    html = F.col("html") if references is None else F.regexp_replace("html", f"&(?!(?:{'|'.join(references)});)", "&amp;")
    first = F.get(F.filter(block_list(html), lambda b: b["heading_level"] == 1), F.lit(0))["content"]
    return pages.select("page_id", F.when(F.col("html").isNotNull(), F.coalesce(first, F.lit(""))).alias("title"))


def _csv_cells(body: str) -> list[dict]:
    rows = [r for r in csv.reader(io.StringIO(body), delimiter=sniff_delimiter(body)) if any(c.strip() for c in r)]
    heads = rows[0] if rows else []
    return [{"row_id": i, "header": (heads[j] if j < len(heads) else "").strip(), "value": v.strip()} for i, r in enumerate(rows[1:]) for j, v in enumerate(r)]


def body_cells(responses: DataFrame) -> DataFrame:
    """url, row_id, header, value of HTTP responses (url, content_type, body) that hold JSON (objects, a list of
    them, or an object with such a list) or CSV, told by the type, else by how the body starts."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    body = F.trim(F.coalesce("body", F.lit("")))
    json_like = kind.contains("json") | (~kind.contains("csv") & body.rlike(r"\A\s*[\[{]"))
    typed = responses.select("url", body.alias("body"), json_like.alias("json"), (kind.contains("csv") | kind.contains("text/plain")).alias("csv"))
    cell = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("header", T.StringType()), T.StructField("value", T.StringType())])

    @F.arrow_udf(T.ArrayType(cell))
    def parse(text: pa.Array) -> pa.Array:
        return pa.array([_csv_cells(t.as_py() or "") for t in text], pa.list_(pa.struct([("row_id", pa.int64()), ("header", pa.string()), ("value", pa.string())])))

    tables = typed.filter("csv and not json").select("url", F.inline(parse("body")))
    fields = F.from_json("body", "map<string,string>")
    listed = F.get(F.filter(F.map_values(fields), lambda v: v.rlike(r"\A\[\s*\{")), F.lit(0))
    whole = F.when(F.col("body").startswith("["), F.col("body")).otherwise(F.coalesce(listed, F.concat(F.lit("["), "body", F.lit("]"))))
    objects = typed.filter("json").select("url", F.posexplode(F.from_json(whole, "array<map<string,string>>")).alias("row_id", "m"))
    values = objects.filter("m is not null").select("url", F.col("row_id").cast("long").alias("row_id"), F.explode("m").alias("header", "value"))
    return tables.unionByName(values)


def body_blocks(responses: DataFrame) -> DataFrame:
    """url, block_index, content, heading_level of responses whose body is text: its lines or paragraphs."""
    from fuseline.operators.narrative import blocks

    return blocks(responses.select(F.col("url").alias("doc_id"), F.col("body").alias("text"))).withColumnRenamed("doc_id", "url")
