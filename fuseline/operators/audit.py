"""Comparison of results: with a baseline (full outer join), with gold data (by position or key),
and of records through the stages (semi and anti joins); validation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import trimmed
from fuseline.operators import entities, narrative


def cell_delta(baseline: DataFrame, filled: DataFrame) -> DataFrame:
    """location, field and change (added, removed, changed) of the cells that differ."""
    a = baseline.select("location", "field", F.col("value").alias("old"))
    b = filled.select("location", "field", F.col("value").alias("new"))
    both = a.join(b, ["location", "field"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select("location", "field", "old", "new", change.alias("change"))


def lineage_outcomes(records: DataFrame, filled: DataFrame) -> DataFrame:
    """Each record (record_id, source_file) is discarded, evidence_only, merged or standalone, by
    the filled cells' origin_record_ids and value_record_ids (arrays)."""
    cited = filled.select(F.explode("origin_record_ids").alias("record_id"), F.size("origin_record_ids").alias("n")).groupBy("record_id").agg(F.max("n").alias("n"))
    used = filled.select(F.explode("value_record_ids").alias("record_id")).distinct().withColumn("used", F.lit(True))
    out = records.join(cited, "record_id", "left").join(used, "record_id", "left")
    outcome = F.when(F.col("n").isNull(), "discarded").when(F.col("used").isNull(), "evidence_only").when(F.col("n") > 1, "merged").otherwise("standalone")
    return out.select("record_id", "source_file", outcome.alias("outcome"))


def missing_calls(required: DataFrame, made: DataFrame) -> DataFrame:
    """required (stage, scopes) for which no successful call of the stage shares a scope."""
    done = made.filter("success").select(F.col("stage").alias("_stage"), F.col("scopes").alias("_scopes"))
    return required.join(done, (F.col("stage") == F.col("_stage")) & F.arrays_overlap("scopes", "_scopes"), "left_anti")


def cell_text(c: Column) -> Column:
    """A cell as gold comparison sees it: numbers to four places, other text with single spaces."""
    text = F.coalesce(trimmed(c.cast("string")), F.lit(""))
    value = F.regexp_replace(text, ",", "").try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.round(value, 4).cast("decimal(30,4)").cast("string"), r"0+$", ""), r"\.$", ".0")
    whole = value.cast("decimal(30,0)").cast("string")
    plain = F.array_join(F.filter(F.split(F.translate(text, "　\xa0", "  "), r"(?U)\s+"), lambda x: x != ""), " ")
    return F.when(value.isNull() | F.isnan(value), plain).when(value == F.floor(value), whole).otherwise(short)


def compare(output: DataFrame, gold: DataFrame, keys: Sequence[str], columns: Sequence[str], ignore_empty: bool = True) -> DataFrame:
    """A row for each compared cell of rows with the same keys: column_name, output, gold, equal.
    keys may be a row number, for comparison by position."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), cell_text(F.col(f"o_{c}")).alias("output"), cell_text(F.col(f"g_{c}")).alias("gold")) for c in columns])
    o = output.select(*keys, *[F.col(c).alias(f"o_{c}") for c in columns])
    g = gold.select(*keys, *[F.col(c).alias(f"g_{c}") for c in columns])
    out = o.join(g, list(keys)).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return (out.filter("gold <> ''") if ignore_empty else out).withColumn("equal", F.col("output") == F.col("gold"))


def accuracy(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell and row accuracy in percent, and whether 80 percent of the cells are right."""
    rows = compared.groupBy(*keys).agg(F.count("*").alias("_cells"), F.count_if("equal").alias("_equal"))
    out = rows.agg(F.sum("_cells").alias("total_cells"), F.sum("_equal").alias("matched_cells"), F.count("*").alias("compared_rows"), F.count_if(F.col("_cells") == F.col("_equal")).alias("matched_rows"))
    out = out.withColumn("cell_accuracy", F.round(F.col("matched_cells") * 100.0 / F.greatest(F.col("total_cells"), F.lit(1)), 2))
    out = out.withColumn("row_accuracy", F.round(F.col("matched_rows") * 100.0 / F.greatest(F.col("compared_rows"), F.lit(1)), 2))
    return out.withColumn("meets_threshold", F.col("cell_accuracy") >= 80)


def similar_outputs(cells: DataFrame) -> DataFrame:
    """n_cells and tasks: tasks whose filled cells (task, row_no, field, value, source_file) are all the same.
    A task's signature is made of sums over its cells' hashes, so no task's cells are gathered."""
    cell = F.struct("row_no", "field", F.coalesce("value", F.lit("")), F.coalesce("source_file", F.lit("")))
    one = cells.withColumns({"_a": F.xxhash64(cell), "_b": F.xxhash64(cell, F.lit(1))})
    signed = one.groupBy("task").agg(F.count("*").alias("n_cells"), F.sum(F.col("_a").cast("decimal(38,0)")).alias("_a"), F.bit_xor("_b").alias("_b"))
    return signed.groupBy("n_cells", "_a", "_b").agg(F.array_sort(F.collect_list("task")).alias("tasks")).filter(F.size("tasks") > 1).select("n_cells", "tasks")


def field_match_rate(cells: DataFrame) -> DataFrame:
    """Percent of cells (value, match_method) with a value other than N/A and a method, and the mean confidence of these."""
    hit = ~F.coalesce("value", F.lit("")).isin("", "N/A") & (F.coalesce("match_method", F.lit("")) != "")
    return cells.agg(F.round(F.count_if(hit) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("match_rate"), F.round(F.avg(F.when(hit, F.col("confidence"))), 4).alias("mean_confidence"))


#: Checks that decide the status; the others are advice.
HARD = ("fill_rate", "rows_filled", "record_coverage", "list_like_record_count", "source_stat_consistency", "metric_consistency")


def validation_checks(filled: DataFrame, sources: DataFrame, expected_rows: int) -> DataFrame:
    """check_name, hard, passed of filled cells (row_id, field, value, source_file, n_evidence,
    confidence) and source statistics (source_file, extracted_rows, filled_rows, contributed)."""
    has = F.coalesce(F.col("value"), F.lit("")) != ""
    f = filled.agg(
        F.count("*").alias("cells"), F.count_if(has).alias("full"), F.count_distinct(F.when(has, F.col("row_id"))).alias("rows"), F.count_distinct("row_id").alias("records"),
        F.count_if(has & ((F.coalesce("n_evidence", F.lit(0)) == 0) | F.col("source_file").isNull())).alias("bare"),
        F.count_if(F.col("confidence").isNotNull()).alias("n_conf"), (F.max("confidence") - F.min("confidence")).alias("spread"), F.stddev_pop("confidence").alias("std"),
    )
    s = sources.agg(F.count_if(F.col("contributed") > F.greatest("filled_rows", "extracted_rows")).alias("odd"), F.count("*").alias("relevant"), F.count_if(F.col("contributed") > 0).alias("contributing"))
    rate = F.when(F.col("cells") > 0, F.col("full") * 100.0 / F.col("cells")).otherwise(0.0)
    checks = {
        "fill_rate": rate >= 80,
        "rows_filled": F.col("rows") > 0,
        "value_without_evidence": F.col("bare") == 0,
        "missing_fields": F.col("cells") - F.col("full") <= F.col("cells") * 0.5,
        "record_coverage": F.lit(expected_rows <= 0) | (F.col("rows") >= max(1, int(expected_rows * 0.8))),
        "list_like_record_count": ~(F.lit(expected_rows > 1) & (F.col("records") <= 1)),
        "source_contribution": (F.col("contributing") > 0) | (F.col("relevant") == 0),
        "source_stat_consistency": F.col("odd") == 0,
        "metric_consistency": (F.lit(expected_rows <= 0) | (F.col("rows") <= expected_rows)) & (F.col("records") >= F.col("rows")),
        "confidence_uniformity": ~((F.col("n_conf") >= 5) & (F.col("spread") < 0.04) & (F.col("std") < 0.015)),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(k in HARD).alias("hard"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return f.join(F.broadcast(s), F.lit(True)).select(F.inline(entries))


#: Those of source_checks() and task_checks() that decide the status.
HARD_SOURCE = ("effective_contribution_alignment", "unstructured_source_contribution", "narrative_pipeline_effectiveness", "repeated_entity_narrative", "narrative_loss_accounting")
HARD_CONTEXT = ("entity_legality", "source_topic_match")
HARD_TASK = ("output_file_exists", "model_usage_truthfulness", "model_usage_validation")


def _checks(one: DataFrame, checks: dict[str, Column], hard: tuple[str, ...]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(k in hard).alias("hard"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return one.select(F.inline(entries))


def source_checks(sources: DataFrame) -> DataFrame:
    """check_name, hard, passed of statistics of relevant sources: source_file, narrative (boolean),
    n_blocks, n_segments, extracted, filtered, contributed, cell_delta, suspicious, unexplained (counts),
    model_run (boolean) and n_reasons, by how many reasons its records were dropped. A check
    passes if no source is against it."""
    told = F.col("narrative")
    against = {
        "effective_contribution_alignment": told & (F.col("contributed") > 0) & (F.col("cell_delta") == 0),
        "narrative_loss_accounting": told & (F.col("unexplained") != 0),
        "narrative_records_extracted": told & (F.col("n_blocks") > 0) & (F.col("extracted") == 0),
        "entity_block_record_flow": told & (F.col("n_blocks") > 0) & (F.col("filtered") == 0),
        "unstructured_source_contribution": told & (F.col("extracted") > 0) & (F.col("contributed") == 0),
        "narrative_source_lower_bound": told & (F.col("extracted") > 0) & (F.col("contributed") <= 0),
        "narrative_pipeline_effectiveness": F.col("model_run") & (F.col("n_segments") >= 3) & ((F.col("extracted") >= 8) | (F.col("suspicious") >= 4)) & (F.col("cell_delta") == 0),
        "repeated_entity_narrative": told & (F.col("n_blocks") >= 3) & (F.col("filtered") <= 1) & (F.col("contributed") == 0),
        "uniform_filter_reason": (F.col("filtered") == 0) & (F.col("extracted") >= 2) & (F.col("n_reasons") == 1),
    }
    one = sources.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in against.items()])
    return _checks(one, {k: F.col(k) == 0 for k in against}, HARD_SOURCE)


def task_checks(tasks: DataFrame, seconds: float = 90.0) -> DataFrame:
    """The same of tasks: has_output (boolean), unresolved, response_time, rows_filled, n_row_ids,
    n_evidence, n_records, model_called (boolean), model_calls, ledger_errors."""
    against = {
        "output_file_exists": ~F.col("has_output"),
        "unresolved_fields": F.col("unresolved") > 0,
        "response_time": F.col("response_time") > seconds,
        "writeback_row_count": (F.col("n_row_ids") > 0) & (F.col("n_row_ids") != F.col("rows_filled")),
        "evidence_report": (F.col("n_evidence") == 0) & (F.col("n_records") > 0),
        "model_usage_truthfulness": F.col("model_called") & (F.col("model_calls") == 0),
        "model_usage_validation": F.col("ledger_errors") > 0,
    }
    one = tasks.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in against.items()])
    return _checks(one, {k: F.col(k) == 0 for k in against}, HARD_TASK)


def illegal_entities(filled: DataFrame) -> DataFrame:
    """The filled cells (field, value and, if it is there, match_method) of entity fields whose value
    can't stand there, with the reason. Placeholders' values are left out."""
    kinds: dict[str, list[str]] = {}
    for (field,) in filled.select("field").distinct().collect():  # a template's fields
        if field and (kind := entities.header_kind(field)):
            kinds.setdefault(kind, []).append(field)
    why = F.lit(None).cast("string")
    for kind, fields in kinds.items():
        why = F.when(F.col("field").isin(fields), entities.reason(F.col("value").cast("string"), kind)).otherwise(why)
    placed = F.coalesce(F.col("match_method") == "placeholder_replace", F.lit(False)) if "match_method" in filled.columns else F.lit(False)
    out = filled.withColumn("reason", why)
    return out.filter(~placed & (F.coalesce(F.col("value"), F.lit("")) != "") & (F.col("value") != "N/A") & (F.col("reason") != "blank"))


def context_checks(filled: DataFrame, sources: DataFrame, template: str) -> DataFrame:
    """check_name, hard, passed of a template's name, its filled cells (field, value) and its relevant
    sources: source_file, narrative (boolean), extracted, contributed, model_run (boolean) and n_stages,
    how many stages counted its records. Topics are those of file names: sources that gave something
    share words with the template, all or none, unless a name lies within the other."""
    ending = r"[-_ ]?模板$"
    words, core = narrative.topic_tokens(F.regexp_replace(narrative.stem(F.lit(template)), ending, "")), narrative.topic_text(F.regexp_replace(narrative.stem(F.lit(template)), ending, ""))
    name = narrative.stem(F.col("source_file"))
    gave = F.coalesce((F.col("extracted") > 0) | (F.col("contributed") > 0), F.lit(False))
    close = gave & (core != "") & (narrative.topic_text(name).contains(core) | core.contains(narrative.topic_text(name)))
    shares = F.arrays_overlap(narrative.topic_tokens(name), words)
    silent = F.col("narrative") & ((F.col("extracted") > 0) | F.col("model_run")) & (F.coalesce(F.col("n_stages"), F.lit(0)) == 0)
    one = sources.agg(
        F.count_if(F.coalesce(close, F.lit(False))).alias("close"), F.count_if(gave & shares).alias("like"), F.count_if(gave & ~shares).alias("unlike"),
        F.count_if(gave & (F.size(narrative.topic_tokens(name)) > 0)).alias("named"), F.count_if(F.coalesce(silent, F.lit(False))).alias("silent"),
    ).join(F.broadcast(illegal_entities(filled).agg(F.count("*").alias("illegal"))), F.lit(True))
    apart = ((F.col("like") > 0) & (F.col("unlike") > 0)) | ((F.col("like") == 0) & (F.col("named") > 0))
    checks = {
        "entity_legality": F.col("illegal") == 0,
        "source_topic_match": (F.col("close") > 0) | (F.size(words) == 0) | ~apart,
        "narrative_stage_audit": F.col("silent") == 0,
    }
    return _checks(one, checks, HARD_CONTEXT)


def report(checks: DataFrame) -> DataFrame:
    """The checks as one JSON text and one Markdown table, as one row."""
    rows = F.array_sort(F.collect_list(F.struct("check_name", "hard", "passed")))
    lines = F.transform("rows", lambda r: F.concat(F.lit("| "), r["check_name"], F.lit(" | "), F.when(r["passed"], "ok").otherwise("failed"), F.lit(" |")))
    head = F.array(F.lit("| check | result |"), F.lit("| --- | --- |"))
    return checks.agg(rows.alias("rows")).select(F.to_json("rows").alias("json"), F.concat_ws("\n", F.concat(head, lines)).alias("markdown"))


def status(checks: DataFrame) -> DataFrame:
    """Whether all hard checks passed, as one row."""
    return checks.agg(F.coalesce(F.every(~F.col("hard") | F.col("passed")), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))
