"""Data-quality rules over cells: one rule is one DataFrame of issues; a report is their union.

Rules that compare cells with the rest of their column aggregate first and join the small result,
so a column of any length is never one task's group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.registry import DEFAULT, Registry
from fuseline.functions.values import clean, is_null_text, name_key, plain_text, rendered, text_date, text_number, text_percent, text_unit
from fuseline.sources.cells import location
from fuseline.sources.scratch import stored

NUMERIC = ("number", "currency", "percent")
SEVERITY = {"cross_source_conflict": "error", "value_without_evidence": "error"}


def header_types(samples: dict[str, list], registry: Registry = DEFAULT) -> dict[str, str]:
    return {h: registry.field_type(h, s) for h, s in samples.items()}


def with_types(cells: DataFrame, types: dict[str, str], registry: Registry = DEFAULT) -> DataFrame:
    """cells with typed: the normalised value, by its header's type. Each part is a column of its
    own on the way, so that no regular expression runs twice on a value."""
    header, text = F.col("header"), F.col("_text")
    among = lambda *kinds: header.isin(*[h for h, k in types.items() if k in kinds])
    kind = F.lit("text")
    for k in sorted(set(types.values()) - {"text"}):
        kind = F.when(among(k), k).otherwise(kind)
    out = cells.withColumns({"_clean": clean(F.col("value")), "_kind": kind}).withColumn("_text", plain_text(F.col("_clean")))
    out = out.withColumn("_null", is_null_text(text, registry))
    none = lambda k: F.lit(None).cast(k)
    kinds, asked = set(types.values()), ~F.col("_null")
    # only the readers of kinds that occur: each is a large expression, which takes the driver longer to build than a few values to read
    num = F.when(asked & among("number", "currency"), text_number(text)) if kinds & {"number", "currency"} else none("double")
    if "percent" in kinds:
        num = F.when(asked & among("percent"), text_percent(text)).otherwise(num)
    own = F.when(among("percent") & text.contains("%"), "%").otherwise(text_unit(text, registry)) if "percent" in kinds else text_unit(text, registry)
    out = out.withColumns({"_num": num, "_day": F.when(among("date"), text_date(text)) if "date" in kinds else none("string"), "_unit": F.when(among("date") | F.col("_null"), "").otherwise(own)})
    out = out.withColumn("_value", F.when(among(*NUMERIC), rendered(F.col("_num"))).when(among("date"), F.col("_day")).otherwise(text))
    typed = F.struct(
        F.col("_clean").alias("original"), F.when(F.col("_null"), "").otherwise(F.coalesce("_value", "_text")).alias("standard_value"), F.col("_num").alias("num"),
        F.col("_kind").alias("field_type"), F.col("_unit").alias("unit"), F.when(F.col("_null"), "null").when(F.col("_value").isNull(), "type_error").otherwise("ok").alias("status"),
    )
    return out.withColumn("typed", typed).drop("_text", "_clean", "_kind", "_null", "_num", "_day", "_unit", "_value")


def _issue(rows: DataFrame, kind: str | Column, field: Column, raw: Column, value: Column, where: Column, source: Column | None = None) -> DataFrame:
    return rows.select(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("issue_type"), F.lit(SEVERITY.get(kind, "warning") if isinstance(kind, str) else "warning").alias("severity"), field.alias("field_name"), raw.alias("raw_value"),
        value.alias("normalized_value"), (source if source is not None else F.col("source")).alias("source"), where.alias("location"),
    )


def cell_issues(cells: DataFrame) -> DataFrame:
    """Missing values, values that don't fit their type and negative numbers, in one pass."""
    status, negative = F.col("typed.status"), (F.col("typed.num") < 0) & ~F.col("header").contains("率")
    wrong = F.when(F.col("typed.field_type") == "date", "date_format_error").otherwise("type_error")
    kinds = F.array(F.when(status == "null", "missing_value"), F.when(status == "type_error", wrong), F.when(negative, "range_anomaly"))
    rows = cells.withColumn("issue", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    return _issue(rows, F.col("issue"), F.col("header"), F.col("typed.original"), F.col("typed.standard_value"), location())


def numeric_anomalies(cells: DataFrame, z: float = DEFAULT.outlier_z, least: int = 5) -> DataFrame:
    """Values at least z population standard deviations off their column's mean."""
    keys = ["source", "table_index", "header"]
    numbers = cells.filter(F.col("typed.num").isNotNull())
    stats = numbers.groupBy(keys).agg(F.avg("typed.num").alias("mean"), F.stddev_pop("typed.num").alias("std"), F.count("*").alias("n"))
    far = numbers.join(stats.filter((F.col("n") >= least) & (F.col("std") > 0)), keys)
    far = far.filter(F.abs((F.col("typed.num") - F.col("mean")) / F.col("std")) >= z)
    return _issue(far, "numeric_anomaly", F.col("header"), clean(F.col("value")), F.col("typed.standard_value"), location())


def duplicate_records(cells: DataFrame) -> DataFrame:
    """Rows of a table whose values, as they are compared, another row has too."""
    prints = cells.filter("col_index = 0 and row_print <> ''").select("source", "table_index", F.col("row_print").alias("print"))
    twice = prints.groupBy("source", "table_index", "print").agg(F.count("*").alias("n")).filter("n > 1")
    return _issue(twice, "duplicate_record", F.lit(""), F.col("print"), F.col("print"), F.concat(F.lit("table"), "table_index"))


def cross_source_conflicts(cells: DataFrame) -> DataFrame:
    """Entity and field with several values from several sources: the least and the greatest differ."""
    mine = cells.filter(F.col("row_key") != "").select("row_key", "header", F.col("typed.standard_value").alias("v"), "source", location().alias("at"))
    keyed = mine.withColumn("k", F.when(F.col("v") != "", name_key(F.col("v"))))
    found = keyed.groupBy("row_key", "header").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min(F.struct("source", "at")).alias("s0"), F.max("source").alias("s1"))
    fields = found.groupBy("row_key", name_key(F.col("header")).alias("field")).agg(F.min("k0").alias("k0"), F.max("k1").alias("k1"), F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    bad = fields.filter("k0 <> k1 and s0.source <> s1")
    return _issue(bad, "cross_source_conflict", F.col("field"), F.concat(F.lit("key="), "row_key"), F.lit(""), F.col("s0.at"), F.concat_ws("；", "s0.source", "s1"))


def analyze(cells: DataFrame, types: dict[str, str], registry: Registry = DEFAULT) -> DataFrame:
    """All issues of the cells."""
    full = stored(with_types(cells, types, registry), "typed_cells")  # regular expressions run once on a cell
    rules = [cell_issues(full), duplicate_records(full), numeric_anomalies(full, registry.outlier_z), cross_source_conflicts(full)]
    return reduce(DataFrame.unionByName, rules)


def analyze_filled(filled: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Issues of filled_cells (field_name, value, source_file, location, confidence, n_evidence)."""
    has = ~F.coalesce(F.col("value"), F.lit("")).isin("", "N/A")
    say = lambda rows, kind: _issue(rows, kind, F.col("field_name"), F.col("value"), F.col("value"), F.col("location"), F.col("source_file"))
    bare = (F.coalesce(F.col("n_evidence"), F.lit(0)) == 0) | (F.coalesce(F.col("source_file"), F.lit("")) == "")
    low = F.col("confidence") < registry.low_confidence
    return say(filled.filter(has & bare), "value_without_evidence").unionByName(say(filled.filter(has & low), "low_confidence")).unionByName(say(filled.filter(~has), "missing_filled_value"))


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("issues"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each column: rows, nulls, distinct values, and for numeric columns the least, the
    greatest, mean and population standard deviation. exact=False: distinct values are estimated by sketches
    that merge, so that no value is shuffled."""
    numeric = {c for c, k in df.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")}
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num")) for c in df.columns])
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    return long.groupBy("column_name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_nulls"), (F.count_distinct("v") if exact else F.approx_count_distinct("v")).alias("n_distinct"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"), F.round(F.avg("num"), 4).alias("mean_num"), F.round(F.stddev_pop("num"), 4).alias("std_num"),
    )
