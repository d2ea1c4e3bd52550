"""Delimited tables in plain text: found, and replaced in place.

A text's lines are rows; a table is an island of them: from the first line that has the headers on to the last line with the delimiter,
over single blank lines. Islands are numbered by running sums over a text's lines, so nothing is looped over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.values import trimmed

ENOUGH_FIELDS, ENOUGH_HEADERS = 0.6, 0.5


def delimiter_of(text: Column) -> Column:
    """A tab, if the text has one or no comma; else a comma."""
    return F.when(F.contains(text, F.lit("\t")) | ~F.contains(text, F.lit(",")), "\t").otherwise(",")


def is_header(line: Column, delimiter: Column, headers: Sequence[str]) -> Column:
    """Whether a line has at least 0.6 times as many fields as there are headers, and half of the headers are in one of them, or
    one of them in it."""
    fields = F.transform(F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1), trimmed)
    has = lambda h: F.exists(fields, lambda f: F.contains(f, F.lit(h)) | F.contains(F.lit(h), f))
    hits = sum((has(h).cast("int") for h in headers), F.lit(0))
    return (trimmed(line) != "") & (F.size(fields) >= ENOUGH_FIELDS * len(headers)) & (hits >= ENOUGH_HEADERS * len(headers))


def text_lines(texts: DataFrame, headers: Sequence[str], text: str = "text") -> DataFrame:
    """doc_id, line_no, line and in_table of each line of texts (doc_id, text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select("doc_id", delimiter_of(body).alias("d"), F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    bare = trimmed(F.col("line"))
    rows = rows.withColumn("with_d", F.contains(bare, F.col("d")))
    rows = rows.withColumn("start", F.min(F.when(is_header(F.col("line"), F.col("d"), headers), F.col("line_no"))).over(upto))
    # a line behind the start that ends the table: text without delimiter, or a blank one before no line with it
    blank = (bare == "") & ~F.coalesce(F.lead("with_d").over(doc), F.lit(False))
    ends = (F.col("line_no") > F.col("start")) & (((bare != "") & ~F.col("with_d")) | blank)
    rows = rows.withColumn("ended", F.coalesce(F.max(ends.cast("int")).over(upto), F.lit(0)))
    return rows.select("doc_id", "line_no", "line", F.coalesce(F.col("start").isNotNull() & (F.col("ended") == 0), F.lit(False)).alias("in_table"))


def replace_tables(texts: DataFrame, headers: Sequence[str], tables: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and replaced: texts with the first table under such headers replaced by tables' (doc_id, rows: an array of arrays
    of values), else with it at the end after a blank line. Texts without new rows stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = delimiter_of(body)
    lines = text_lines(texts, headers, text)
    pick = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct("line_no", "line"))))["line"]
    first = F.min(F.when(F.col("in_table"), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    parts = lines.withColumn("first", first).groupBy("doc_id").agg(F.max("first").alias("first"), pick(~F.col("in_table") & (F.col("line_no") < F.col("first"))).alias("above"), pick(~F.col("in_table") & (F.col("line_no") > F.col("first"))).alias("below"))
    joined = lambda values: F.call_function("array_join", values, F.col("d"))  # noqa: E731  its delimiter is a column here
    filled = F.transform("rows", lambda r: joined(F.transform(r, lambda v: F.coalesce(v, F.lit("")))))
    table = F.array_join(F.concat(F.array(joined(F.array(*map(F.lit, headers)))), filled), "\n")
    rows = texts.select("doc_id", body.alias("old"), d.alias("d")).join(parts, "doc_id").join(tables.select("doc_id", "rows"), "doc_id", "left")
    full = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))
    around = F.array_join(F.filter(F.array(full(F.col("above")), F.col("table"), full(F.col("below"))), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    rows = rows.withColumn("table", table)
    done = F.when(F.col("rows").isNull(), F.col("old")).when(F.col("first").isNotNull(), around).otherwise(F.concat("old", F.lit("\n\n"), "table"))
    return rows.select("doc_id", done.alias("text"), (F.col("first").isNotNull() & F.col("rows").isNotNull()).alias("replaced"))
