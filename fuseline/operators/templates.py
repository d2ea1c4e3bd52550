"""Templates: their headers and placeholders, and filling them.

A template is a small file of a known form. Records are matched to its slots on Spark. One document
holds all records; office.fill_copies writes those of large results as many, in parallel."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuseline.operators.mapping import match_headers, project
from fuseline.operators.position import numbered

PLACEHOLDER = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}|【([^】]+)】|\$?\{\s*([^{}]+?)\s*\}")
TABLE_ROW = re.compile(r"^\s*\|(.+)\|\s*$")


@dataclass
class Template:
    kind: str
    headers: list[str] = field(default_factory=list)
    placeholders: list[str] = field(default_factory=list)
    text: str = ""


def inspect(text: str, kind: str) -> Template:
    """The headers (csv: first row; markdown: of its first table) and placeholders of a template."""
    names = list(dict.fromkeys(next(g for g in m.groups() if g) for m in PLACEHOLDER.finditer(text)))
    headers: list[str] = []
    if kind == "csv":
        headers = [h.strip() for h in next(csv.reader(io.StringIO(text)), [])]
    elif kind == "markdown":
        row = next((m for m in map(TABLE_ROW.match, text.splitlines()) if m), None)
        headers = [h.strip() for h in row.group(1).split("|")] if row else []
    return Template(kind, headers, names, text)


def fill_cells(records: DataFrame, headers: Sequence[str], order: str, slots: int | None = None) -> DataFrame:
    """row_no (from 1), field, value, source_file of the template's cells: records' columns matched with
    its headers, in records' order, as many as there are slots (None: all, which no one task numbers)."""
    pairs = match_headers(list(headers), [c for c in records.columns if c not in (order, "source_file")])
    keep = [F.col(order).alias("_order")] + ([F.col("source_file")] if "source_file" in records.columns else [F.lit(None).cast("string").alias("source_file")])
    rows = records.select(*keep, *[F.col(s).cast("string").alias(t) for t, s, _ in pairs])
    if slots is not None:
        rows = rows.orderBy("_order").limit(slots)
        rows = rows.withColumn("row_no", F.row_number().over(Window.orderBy("_order")))  # at most slots rows
    else:
        rows = numbered(rows, ["_order"])
    entries = F.array(*[F.struct(F.lit(h).alias("field"), (F.col(h) if h in {t for t, _, _ in pairs} else F.lit(None).cast("string")).alias("value")) for h in headers])
    return rows.select("row_no", "source_file", F.explode(entries).alias("c")).select("row_no", "c.field", "c.value", "source_file")


def fill_rate(cells: DataFrame) -> DataFrame:
    has = F.coalesce(F.col("value"), F.lit("")) != ""
    return cells.agg(F.round(F.count_if(has) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("fill_rate"), F.count_distinct(F.when(has, F.col("row_no"))).alias("rows_filled"))


def write_csv(records: DataFrame, headers: Sequence[str], path: str) -> None:
    """All records under the template's headers, as CSV files that Spark writes in parallel."""
    project(records, match_headers(list(headers), records.columns)).write.mode("overwrite").csv(path, header=True)


def matched_rows(records: DataFrame, headers: Sequence[str], order: str) -> tuple[list[str], list[list[str]]]:
    """(the matched headers, rows of all records' values as text, in order)."""
    pairs = match_headers(list(headers), [c for c in records.columns if c != order])
    rows = project(records.orderBy(order), pairs).collect() if pairs else []
    return [p[0] for p in pairs], [["" if v is None else str(v) for v in r] for r in rows]


def markdown_with(template: Template, names: Sequence[str], values: Sequence[Sequence[str]]) -> str:
    """The template's text with the rows of its first table replaced by values under names."""
    by = [dict(zip(names, r, strict=True)) for r in values]
    body = ["| " + " | ".join(r.get(h, "") for h in template.headers) + " |" for r in by]
    out, inside, done = [], False, False
    for line in template.text.splitlines():
        is_row = bool(TABLE_ROW.match(line))
        if is_row and not done:
            if not inside:
                out += [line, "|" + " --- |" * len(template.headers), *body]
            inside = True
            continue
        done = done or inside
        out.append(line)
    return "\n".join(out)


def fill_markdown(template: Template, records: DataFrame, order: str) -> str:
    """The template's text with the rows of its first table replaced by all records."""
    return markdown_with(template, *matched_rows(records, template.headers, order))


def first_values(records: DataFrame, column: str, order: str, first: int = 5) -> str:
    """The first different values of a column of all records, joined by ；."""
    value = F.col(f"`{column}`").cast("string")
    got = records.filter(value != "").groupBy(value.alias("v")).agg(F.min(order).alias("o")).orderBy("o", "v").limit(first).collect()
    return "；".join(r["v"] for r in got)


def fill_placeholders(template: Template, records: DataFrame, order: str, first: int = 5) -> str:
    """The template's text with each placeholder replaced by the first different values of the
    column that matches its name, joined by ；."""
    pairs = match_headers(template.placeholders, [c for c in records.columns if c != order])
    text = template.text
    for name, column, _ in pairs:
        value = first_values(records, column, order, first)
        for mark in (f"{{{{{name}}}}}", f"${{{name}}}", f"{{{name}}}", f"【{name}】"):
            text = text.replace(mark, value)
    return text
