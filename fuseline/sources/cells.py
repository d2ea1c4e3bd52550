"""The uniform model: a cell per row, with its source, place, header and text.

source, file_type, priority, table_index, row_id, col_index, header, value, row_key, row_print:
row_key is the first of the row's first two values that isn't empty, as it is compared; a cell of the
first column has only its own. row_print, at the first column only, is all of the row's values as
they are compared, numbers with sign and point: both come from the wide row, so that rules need not
gather its cells again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import clean, name_key, value_key

COLUMNS = ["source", "file_type", "priority", "table_index", "row_id", "col_index", "header", "value", "row_key", "row_print"]


def as_text(df: DataFrame, column: str) -> Column:
    """A column as readers would give it: doubles without exponent, timestamps without zone."""
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float"):
        from fuseline.functions.values import rendered

        return rendered(F.col(column).cast("double"))
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else F.col(column).cast("string")


def cells_of(df: DataFrame, source: str, row_id: Column, columns: list[str] | None = None, file_type: str = "csv", priority: int = 0, table_index: int = 0) -> DataFrame:
    """The cells of a wide table; one narrow pass that emits each row's cells."""
    columns = columns or df.columns
    # each value is made text, cleaned and keyed once
    wide = df.select(row_id.cast("string").alias("row_id"), *[as_text(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    wide = wide.withColumns({f"_c{i}": clean(F.col(f"_v{i}")) for i in range(len(columns))})
    wide = wide.withColumns({f"_k{i}": name_key(F.col(f"_c{i}")) for i in range(len(columns))})
    entries = F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(c).alias("header"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(columns)])
    key = F.when(F.col("_c0") != "", F.col("_k0")).otherwise(F.col("_k1") if len(columns) > 1 else F.lit(""))
    keys = F.filter(F.array(*[value_key(F.col(f"_c{i}"), F.col(f"_k{i}")) for i in range(len(columns))]), lambda x: x != "")
    rows = wide.select("row_id", F.col("_k0").alias("k0"), key.alias("k"), F.concat_ws("|", keys).alias("p"), F.explode(entries).alias("c"))
    return rows.select(
        F.lit(source).alias("source"), F.lit(file_type).alias("file_type"), F.lit(priority).alias("priority"), F.lit(table_index).alias("table_index"),
        "row_id", "c.col_index", "c.header", "c.value", F.when(F.col("c.col_index") == 0, F.col("k0")).otherwise(F.col("k")).alias("row_key"), F.when(F.col("c.col_index") == 0, F.col("p")).alias("row_print"),
    )


def location() -> Column:
    """A cell's place as text."""
    return F.concat(F.lit("table"), "table_index", F.lit(".row"), "row_id", F.lit(".col"), (F.col("col_index") + 1).cast("string"))
