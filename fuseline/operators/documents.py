"""Operations on documents that a user asks for in words: what is asked, for which fields, and documents as
lines of text to be written."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import clean, plain
from fuseline.sources.cells import as_text

# Words that tell what is asked for, the first line that has one.
INTENTS = (
    ("summarize", ("摘要", "总结", "概括", "summarize", "summary")),
    ("extract", ("提取", "抽取", "字段", "extract")),
    ("find", ("查找", "搜索", "定位", "find", "search")),
    ("replace", ("替换", "占位符", "replace")),
    ("export_table", ("导出表格", "导出", "export")),
    ("format", ("整理", "格式", "format")),
)
FIELDS = re.compile(r"(?:字段|提取|抽取)[：:]\s*([^\n。]+)")


def intent(instruction: Column, operation: Column | None = None) -> Column:
    """What is asked for: the operation if it is named, else what the instruction's words tell, else inspect."""
    out = F.lit("inspect")
    for name, words in reversed(INTENTS):
        out = F.when(F.coalesce(instruction, F.lit("")).rlike("|".join(words)), name).otherwise(out)
    if operation is None:
        return out
    named = F.lower(F.trim(F.coalesce(operation, F.lit(""))))
    return F.when(named != "", named).otherwise(out)


def asked_fields(instruction: str) -> list[str]:
    """The fields that an instruction lists."""
    found = FIELDS.search(instruction or "")
    return [f for f in map(str.strip, re.split(r"[,，、;；]", found.group(1))) if f] if found else []


def labelled(docs: DataFrame, fields: Sequence[str], text: str = "text") -> DataFrame:
    """doc_id, field, value and confidence of every "field: value" anywhere in a text."""
    def values(f: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"{re.escape(f)}\s*[：:]\s*([^\n，,；;。]+)"), 1)
        return F.transform(found, lambda v: F.struct(F.lit(f).alias("field"), clean(v).alias("value"), F.lit(0.7).alias("confidence")))

    return docs.select("doc_id", F.inline(F.concat(*[values(f) for f in fields])))


def table_lines(tables: dict[str, tuple[DataFrame, str]], separator: str = ",") -> DataFrame:
    """table_no, part, at, line: all tables (rows and the column of their order) as lines of text: a title
    (part 0), the headers (1), the rows (2) by their order, and an empty line (3). Rows are written where
    they lie; orderBy("table_no", "part", "at") before writing gives one text."""
    out = None
    for no, (name, (df, order)) in enumerate(tables.items()):
        columns = [c for c in df.columns if c != order]
        if separator == ",":
            cells = F.to_csv(F.struct(*[as_text(df, c).alias(c) for c in columns]))
            rows = df.select(F.lit(no).alias("table_no"), F.lit(2).alias("part"), F.col(order).cast("string").alias("at"), cells.alias("line"))
        else:
            cells = F.concat_ws(separator, *[F.coalesce(as_text(df, c), F.lit("")) for c in columns])
            rows = df.select(F.lit(no).alias("table_no"), F.lit(2).alias("part"), F.col(order).cast("string").alias("at"), cells.alias("line"))
        head = [(no, 0, "", separator.join((f"# table {no}", name))), (no, 1, "", separator.join(columns)), (no, 3, "", "")]
        head = df.sparkSession.createDataFrame(head, "table_no int, part int, at string, line string")
        both = head.unionByName(rows)
        out = both if out is None else out.unionByName(both)
    return out


def formatted_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, block_index and line: each block in plain form, those that hold something."""
    return blocks.select("doc_id", "block_index", plain(F.col("content")).alias("line")).filter("line <> ''")


def row_identifier(location: Column) -> Column:
    """What names the row of a target location: sheet!row, tableN.rowM, or another name.rowM; else ""."""
    sheet = F.regexp_extract(location, r"^([^!]+)![A-Z]+(\d+)$", 1)
    row = F.regexp_extract(location, r"^([^!]+)![A-Z]+(\d+)$", 2)
    named = F.coalesce(*[F.when(x != "", x) for x in (F.regexp_extract(location, r"(table\d+\.row\d+)", 1), F.regexp_extract(location, r"([a-z_]+\d*\.row\d+)", 1))], F.lit(""))
    return F.coalesce(F.when(row != "", F.concat_ws("!", sheet, row)).otherwise(named), F.lit(""))
