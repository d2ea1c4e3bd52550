"""Comparison by position: the n-th row of a result against the n-th row of its gold.

Row numbers need the order of all rows but not one task with all rows: rows are range-partitioned and sorted, each
partition numbers its own, and the counts of the partitions before it (one figure for each, added up on the driver) are added."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuseline.operators.audit import cell_text
from fuseline.sources.scratch import stored

_TASK = 33  # bits of a row's place in its task in Spark's increasing ids


def numbered(rows: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """rows with their number from 1 in the given order; equal ones in any order. The rows are stored on the way,
    so that the numbers stay."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = sorted(placed.groupBy(F.shiftright(name, _TASK).cast("int").alias("task")).count().collect())
    before = [(task, n) for (task, _), n in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)]
    # a row for each partition, so small as to go with the tasks
    starts = F.broadcast(spark.createDataFrame(before, "_task int, _before long"))
    out = placed.join(starts, F.shiftright(name, _TASK).cast("int") == F.col("_task"))
    return out.withColumn(name, F.col("_before") + F.col(name).bitwiseAND((1 << _TASK) - 1) + 1).select(*rows.columns, name)


def compare_positions(output: DataFrame, gold: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """row_no, column_name, output, gold and status of the cells of two tables (with row_no), by row number. Of rows
    that both have: equal or different; of further rows: missing (gold has a value) or extra (the output has).
    A column that only one of them has is empty in the other. With ignore_empty, cells without a gold value in
    rows that both have don't count."""
    columns = list(dict.fromkeys([c for d in (gold, output) for c in d.columns if c != "row_no"]))

    def cells(d: DataFrame, side: str) -> DataFrame:
        return d.select("row_no", F.array(*[cell_text(F.col(f"`{c}`")) if c in d.columns else F.lit("") for c in columns]).alias(side))

    both = cells(output, "o").join(cells(gold, "g"), "row_no", "full_outer")
    status = F.when(F.col("o").isNull(), "missing").when(F.col("g").isNull(), "extra")
    each = F.posexplode(F.transform(F.array(*map(F.lit, columns)), lambda c, i: F.struct(c.alias("column_name"), F.coalesce(F.get("o", i), F.lit("")).alias("output"), F.coalesce(F.get("g", i), F.lit("")).alias("gold"))))
    out = both.select("row_no", status.alias("status"), each.alias("at", "c")).select("row_no", "c.*", "status")
    wanted = F.when(F.col("status") == "missing", F.col("gold") != "").when(F.col("status") == "extra", F.col("output") != "").otherwise(F.lit(not ignore_empty) | (F.col("gold") != ""))
    return out.filter(wanted).withColumn("status", F.coalesce("status", F.when(F.col("output") == F.col("gold"), "equal").otherwise("different")))


def positional_accuracy(output: DataFrame, gold: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """One row: counts of rows and cells, cell and row accuracy in percent, and whether 80 percent of the cells are
    right. A row that both have and of which no cell counts is right."""
    cells = compare_positions(output, gold, ignore_empty)
    sizes = output.agg(F.count("*").alias("output_row_count")).join(F.broadcast(gold.agg(F.count("*").alias("gold_row_count"))))  # one row each
    per_row = cells.groupBy("row_no").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("equal", "different", "missing", "extra")])
    sums = per_row.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("equal", "different", "missing", "extra")], F.count_if(F.col("different") > 0).alias("wrong_rows"))
    percent = lambda a, b: F.round(a * F.lit(100.0) / F.greatest(b, F.lit(1)), 2)
    out = sizes.join(F.broadcast(sums)).withColumn("compared_rows", F.least("output_row_count", "gold_row_count"))
    out = out.withColumns({"total_cells": F.col("equal") + F.col("different"), "matched_rows": F.col("compared_rows") - F.col("wrong_rows")})
    out = out.withColumns({"cell_accuracy": percent(F.col("equal"), F.col("total_cells")), "row_accuracy": percent(F.col("matched_rows"), F.col("compared_rows"))})
    return out.select("output_row_count", "gold_row_count", "compared_rows", "total_cells", F.col("equal").alias("matched_cells"), "matched_rows", F.col("missing").alias("missing_cells"), F.col("extra").alias("extra_cells"), "cell_accuracy", "row_accuracy", (F.col("cell_accuracy") >= 80).alias("meets_threshold"))
