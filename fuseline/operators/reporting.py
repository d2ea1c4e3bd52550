"""A task's report: figures, distributions and the first entries of its lists, as rows.

Each part is one aggregation or a bounded first-k, which Spark cuts in every task before anything is shuffled, so cells,
issues and conflicts may be as many as they like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.registry import DEFAULT, Registry
from fuseline.operators.extraction import source_contributions

#: Fixed: a cell below this is told of, and how many entries a list has, in all and of conflicts for each template.
LOW, LISTED, CONFLICTS = 0.45, 100, 50


def _rows(df: DataFrame, section: str, item: Column, text: Column | None = None, value: Column | None = None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def _counts(df: DataFrame, section: str, column: str) -> DataFrame:
    return _rows(df.groupBy(F.coalesce(column, F.lit("")).alias("item")).agg(F.count("*").alias("n")), section, F.col("item"), value=F.col("n"))


def template_rates(cells: DataFrame) -> DataFrame:
    """template, n_fields, rows_filled, fill_rate and field_match_rate (percent) of filled cells (template, row_no, value,
    match_method): a cell counts as filled unless it is blank or N/A, and as matched if it also tells how it was found."""
    full = ~F.coalesce("value", F.lit("")).isin("", "N/A")
    percent = lambda test: F.round(F.count_if(test) * 100.0 / F.count("*"), 4)
    return cells.groupBy("template").agg(
        F.count("*").alias("n_fields"), F.count_distinct(F.when(full, F.col("row_no"))).alias("rows_filled"), percent(full).alias("fill_rate"),
        percent(full & (F.coalesce("match_method", F.lit("")) != "")).alias("field_match_rate"),
    )


def task_report(cells: DataFrame, sources: DataFrame, issues: DataFrame, conflicts: DataFrame, checks: DataFrame, listed: int = LISTED, per_template: int = CONFLICTS) -> DataFrame:
    """section, item, text and value of a task.

    cells: template, row_no, field_name, location, value, match_method, confidence; sources: source_file, file_type (a row for each
    use); issues: issue_type; conflicts: template, entity_key, field, left_value, right_value; checks: check_name, passed.
    figures are counts, and means over templates; source_types and issue_types are distributions; templates tells each one's rates;
    low_confidence_fields, conflict_fields and validation_failures are the first so many, by template and place. A null confidence isn't low;
    empty tables give figures of 0 and no lists."""
    rates = template_rates(cells)
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    figures = [
        sources.agg(F.count_distinct("source_file").alias("v")).select(F.lit("data_source_count").alias("k"), F.col("v").cast("double")),
        issues.agg(F.count("*").alias("v")).select(F.lit("quality_issue_count").alias("k"), F.col("v").cast("double")),
    ]
    by_template = rates.agg(F.count("*").cast("double").alias("template_count"), mean("fill_rate").alias("fill_rate"), mean("field_match_rate").alias("field_match_rate"))
    figures.append(by_template.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in by_template.columns]))))
    low = cells.filter(F.col("confidence") < LOW).orderBy("template", "location", "field_name").limit(listed)
    place = F.row_number().over(Window.partitionBy("template").orderBy("entity_key", "field", "left_value", "right_value"))
    some = conflicts.withColumn("place", place).filter(F.col("place") <= per_template).orderBy("template", "place").limit(listed)
    failed = checks.filter(~F.coalesce("passed", F.lit(False))).orderBy("check_name").limit(listed)
    parts = [
        _rows(reduce(DataFrame.unionByName, figures), "figures", F.col("k"), value=F.col("v")),
        _counts(sources, "source_types", "file_type"),
        _counts(issues, "issue_types", "issue_type"),
        _rows(rates, "templates", F.col("template"), F.concat_ws("/", F.col("rows_filled").cast("string"), F.col("n_fields").cast("string")), F.col("fill_rate")),
        _rows(low, "low_confidence_fields", F.concat_ws(":", "template", "location"), F.col("field_name"), F.col("confidence")),
        _rows(some, "conflict_fields", F.concat_ws(":", "template", "entity_key", "field"), F.concat_ws(" <> ", "left_value", "right_value")),
        _rows(failed, "validation_failures", F.col("check_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The sections of the Markdown form and their headings, in order.
HEADINGS = {"figures": "Figures", "templates": "Templates", "source_types": "Sources", "issue_types": "Issues", "low_confidence_fields": "Low confidence", "conflict_fields": "Conflicts", "validation_failures": "Failed checks"}


def markdown(report: DataFrame) -> DataFrame:
    """The report as one Markdown text, section after section; its lists are bounded, so one row holds it."""
    order = F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("section"))
    line = F.concat(F.lit("- "), F.concat_ws(" ", "item", "text", F.col("value").cast("string")))
    lines = report.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("item", line.alias("line"))))["line"].alias("lines"))
    head = F.try_element_at(F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair]), F.col("section"))
    parts = lines.select(order.alias("at"), F.concat_ws("\n", F.concat(F.lit("## "), head), F.concat_ws("\n", "lines")).alias("part"))
    return parts.agg(F.concat_ws("\n\n", F.array_sort(F.collect_list(F.struct("at", "part")))["part"]).alias("markdown"))


def source_stats(sources: DataFrame, raw: DataFrame, kept: DataFrame, dropped: DataFrame, blocks: DataFrame, cells: DataFrame, first: int = 3) -> DataFrame:
    """What each source gave a template, a row for each of sources (source_file, file_type, matched: its context is the
    template's, invalid: its candidates were no legal entities).

    raw: records before merging (source_file); kept: those after it (sources, array); dropped: source_file and reason;
    blocks: source_file and n, its entity blocks in each table; cells: row_id, evidence_sources and value_sources (arrays).
    extracted, filtered, entity_blocks (the greatest), n_evidence, n_values and contributed (rows, no more than are filled) are counts,
    reasons the first most frequent ones as "reason xN". An invalid source that gave nothing isn't matched; relevant is one that is
    matched or gave something, relevance_score 1 for the first plus 0.5 for the second. warnings: rows_over_filled, rows_over_extracted,
    illegal_entities, not_relevant or nothing_given, where they hold. Every part is counted before it is joined."""
    count = lambda df, name: df.groupBy("source_file").agg(F.count("*").alias(name))
    each = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("n"), "reason"))
    why = dropped.groupBy("source_file", "reason").agg(F.count("*").alias("n")).withColumn("place", each).filter(F.col("place") <= first)
    why = why.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("reason", F.lit(" x"), F.col("n").cast("string")).alias("text"))))["text"].alias("reasons"))
    parts = [
        count(raw, "extracted"), count(kept.select(F.explode(F.array_distinct("sources")).alias("source_file")), "filtered"), blocks.groupBy("source_file").agg(F.max("n").cast("long").alias("entity_blocks")),
        source_contributions(cells), why,
    ]
    out = sources
    for part in parts:
        out = out.join(part, "source_file", "left")
    counts = ["extracted", "filtered", "entity_blocks", "n_evidence", "n_values", "n_rows"]
    filled = cells.filter(F.size("value_sources") > 0).agg(F.count_distinct("row_id").alias("_filled"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}).join(F.broadcast(filled), F.lit(True))
    gave = (F.col("filtered") > 0) | (F.col("n_values") > 0)
    void = F.coalesce("invalid", F.lit(False)) & ~gave
    out = out.withColumns({"contributed": F.least("n_rows", "_filled"), "_void": void, "_matched": F.coalesce("matched", F.lit(False)) & ~void, "_gave": gave | (F.col("n_evidence") > 0)})
    relevant = F.col("_matched") | F.col("_gave")
    told = {
        "rows_over_filled": F.col("n_rows") > F.col("_filled"),
        "rows_over_extracted": (F.col("extracted") > 0) & (F.col("contributed") > F.col("extracted")),
        "illegal_entities": F.col("_void"),
        "not_relevant": ~relevant,
        "nothing_given": relevant & ~F.col("_gave"),
    }
    warnings = F.filter(F.array(*[F.when(test, name) for name, test in told.items()]), lambda x: x.isNotNull())
    score = F.when(F.col("_matched"), 1.0).otherwise(0.0) + F.when(F.col("_gave"), 0.5).otherwise(0.0)
    return out.select("source_file", "file_type", *counts[:-1], "contributed", relevant.alias("relevant"), score.alias("relevance_score"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), warnings.alias("warnings"))


def _canonical(cells: DataFrame, registry: Registry) -> tuple[DataFrame, Column]:
    """The cells that have a value, and their canonical field."""
    headers = [r[0] for r in cells.select("header").distinct().collect()]  # as many as columns
    names = F.create_map(*[F.lit(x) for h in headers for x in (h, registry.canonical_name(h) or h)]) if headers else F.create_map().cast("map<string,string>")
    return cells.filter(F.coalesce("value", F.lit("")) != ""), F.try_element_at(names, F.col("header"))


def normalization_report(cells: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """section (field, type, status or unit), item and n of typed cells that have a value, counted in one pass; fields are
    canonical ones, or the header where it has none, and values without a unit count for none."""
    full, field = _canonical(cells, registry)
    entry = lambda section, item: F.struct(F.lit(section).alias("section"), item.alias("item"))
    entries = F.array(entry("field", field), entry("type", F.col("typed.field_type")), entry("status", F.col("typed.status")), entry("unit", F.col("typed.unit")))
    return full.select(F.explode(entries).alias("e")).select("e.*").filter("item <> ''").groupBy("section", "item").agg(F.count("*").alias("n"))


def normalization_examples(cells: DataFrame, first: int = 24, registry: Registry = DEFAULT) -> DataFrame:
    """The first few typed cells with a value, by source, table, row and column, as they were and as they are read."""
    full, field = _canonical(cells, registry)
    some = full.orderBy("source", "table_index", F.length("row_id"), "row_id", "col_index").limit(first)
    return some.select(F.col("header").alias("field_name"), field.alias("canonical_field"), F.col("value").alias("raw_value"), "typed.standard_value", "typed.field_type", "typed.unit", "typed.status")
