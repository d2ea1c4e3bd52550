"""Records from text by rules: numbers near their names, labelled values, leading entities; with
confidence, provenance and the stages' losses."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import _SPACE, clean, let, plain
from fuseline.operators.entities import FieldKind, verdict
from fuseline.operators.records import scope_confidence

NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?\s*(?:万亿|亿|万|千|百)?(?:元|人|例|份|个|%)?"
#: Fixed: names under which the concepts are written.
CONCEPTS = {
    "gdp": ("GDP", "地区生产总值", "生产总值", "经济总量"),
    "population": ("常住人口", "总人口", "人口", "population"),
    "budget": ("一般公共预算收入", "财政收入", "预算", "budget"),
    "cases": ("确诊病例", "新增病例", "病例", "cases"),
    "tests": ("核酸检测", "检测量", "检测", "tests"),
}
LEADING = r"^\s*(?:[-*•]|\d+[.)、])?\s*([一-龥]{2,8}?(?:省|市|区|县|州|自治区)|[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,3})"


def near_number(text: Column, names: Sequence[str], reach: int = 32) -> Column:
    """The first number at most reach characters behind one of the names, the first name that has
    one; else one at most reach characters before it."""
    # most texts lack most names: looking for a name is cheap, a pattern over a long text isn't
    has = lambda low, n: F.contains(low, F.lit(n.lower()))
    behind = [(n, rf"(?i){re.escape(n)}[^\d\n]{{0,{reach}}}?({NUMBER})") for n in names]
    before = [(n, rf"(?i)({NUMBER})[^\d\n]{{0,{reach}}}?{re.escape(n)}") for n in names]

    def first(low: Column) -> Column:
        found = [F.when(has(low, n), F.regexp_extract(text, pattern, 1)) for n, pattern in behind + before]
        return F.coalesce(*[F.when(x != "", F.trim(x)) for x in found], F.lit(""))

    return let(F.lower(text), first)


def near_digits(text: Column, names: Sequence[str], reach: int = 32) -> Column:
    """The text with white space runs as one space and its long stretches without a digit cut to their ends, for near_number():
    what lies within reach of a number, with the longest name and a unit, stays; names must hold no digits."""
    keep = reach + max(map(len, names)) + 16
    spaces = F.regexp_replace(text, f"{_SPACE}{{2,}}|[{_SPACE}&&[^ ]]", " ")  # single spaces, nearly all there are, stay untouched
    runs = F.regexp_extract_all(spaces, F.lit("[^0-9０-９]+|[0-9０-９]+"), 0)
    ends = lambda x: F.when((F.length(x) > 2 * keep) & ~x.rlike(r"\A[0-9０-９]"), F.concat(F.left(x, F.lit(keep)), F.right(x, F.lit(keep)))).otherwise(x)
    return F.array_join(F.transform(runs, ends), "")


def concept_value(text: Column, concept: str) -> Column:
    return near_number(plain(text), CONCEPTS[concept])


DATE = r"(?:19\d{2}|20\d{2}|2100)[-/.年](?:1[0-2]|0?[1-9])(?:[-/.月](?:3[01]|[12]\d|0?[1-9]))?[日号]?"


def near_date(text: Column, names: Sequence[str]) -> Column:
    """The date right behind one of the names, the first name that has one; else the text's first date."""
    behind = [F.regexp_extract(text, rf"{re.escape(n)}[：:\s]{{0,3}}({DATE})", 1) for n in names]
    return F.coalesce(*[F.when(x != "", x) for x in behind], F.regexp_extract(text, f"({DATE})", 1))


def entity_estimate(segments: DataFrame, tables: DataFrame) -> DataFrame:
    """source_file and n_entities, how many entities a source likely has: the most of its tables' rows (tables:
    source_file, n_rows) or the different leading entities of its segments (source_file, content), and where
    there are neither, its list items."""
    entity = F.when(leading_entity(F.col("content")) != "", leading_entity(F.col("content")))
    text = segments.groupBy("source_file").agg(F.count_distinct(entity).alias("led"), F.count_if(F.col("content").rlike(r"^\s*(?:\d+[.)]|[-*•])\s+")).alias("items"))
    rows = tables.groupBy("source_file").agg(F.max("n_rows").alias("n_rows"))
    both = text.join(rows, "source_file", "full")
    most = F.greatest(F.coalesce("n_rows", F.lit(0)), F.coalesce("led", F.lit(0)))
    return both.select("source_file", F.when(most > 0, most).otherwise(F.coalesce("items", F.lit(0))).alias("n_entities"))


def leading_entity(text: Column) -> Column:
    return F.regexp_extract(text, LEADING, 1)


def text_confidence(method: Column, value: Column) -> Column:
    """Confidence of a value that a rule found in text; fixed constants of the model."""
    base = {"text_exact": (0.92, 0.90, 0.98), "text_context": (0.84, 0.80, 0.89), "entity_lead": (0.82, 0.78, 0.88), "text_approx": (0.75, 0.70, 0.84)}
    v = clean(value)
    lift = F.least(F.lit(0.018), F.length(v) * 0.001) + F.when(v.rlike(r"\d"), 0.012).otherwise(0.0) - F.when(v.contains(","), 0.004).otherwise(0.0) + F.when(v.contains("."), 0.006).otherwise(0.0) - F.when(F.length(v) == 1, 0.05).otherwise(0.0)
    out = F.lit(None).cast("double")
    for name, (b, low, high) in base.items():
        out = F.when(method == name, F.round(F.greatest(F.lit(low), F.least(F.lit(high), b + lift)), 4)).otherwise(out)
    return out


def text_records(segments: DataFrame, concepts: Sequence[str] = tuple(CONCEPTS), least: int = 1) -> DataFrame:
    """doc_id, block_index, entity, values (map of the concepts found), confidence (map) of segments
    (doc_id, block_index, content) in which at least so many concepts have a number."""
    read = lambda x: F.create_map(*[y for c in concepts for y in (F.lit(c), near_number(x, CONCEPTS[c]))])
    text = plain(near_digits(F.col("content"), [n for c in concepts for n in CONCEPTS[c]]))
    values = F.map_filter(let(text, read), lambda _, v: v != "")
    # a generated row, so that the optimizer doesn't work the values out a second time in a filter
    enough = F.filter(F.array(F.struct(values.alias("values"))), lambda r: F.size(r["values"]) >= least)
    out = segments.select("doc_id", "block_index", leading_entity(F.col("content")).alias("entity"), F.inline(enough))
    return out.withColumn("confidence", F.transform_values("values", lambda _, v: text_confidence(F.lit("text_context"), v)))


def provenance_id(*parts: Column) -> Column:
    """16 hexadecimal digits that name a record by where it comes from and what it says."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def stage_losses(counts: DataFrame, stages: Sequence[str]) -> DataFrame:
    """source_file, stage, n_in, n_out, n_lost of counts (source_file and a column for each stage,
    how many records are left after it), and whether no stage has more than the one before."""
    steps = F.array(*[F.struct(F.lit(b).alias("stage"), F.col(a).alias("n_in"), F.col(b).alias("n_out"), (F.col(a) - F.col(b)).alias("n_lost")) for a, b in zip(stages, stages[1:], strict=False)])
    return counts.select("source_file", F.inline(steps)).withColumn("explained", F.col("n_lost") >= 0)


def source_contributions(cells: DataFrame) -> DataFrame:
    """For each source, cells it is evidence for, cells it gave the value of, and its distinct rows,
    of cells (row_id, evidence_sources, value_sources as arrays)."""
    evidence = cells.select("row_id", F.explode("evidence_sources").alias("source_file")).withColumn("kind", F.lit("evidence"))
    value = cells.select("row_id", F.explode("value_sources").alias("source_file")).withColumn("kind", F.lit("value"))
    both = evidence.unionByName(value)
    return both.groupBy("source_file").agg(F.count_if(F.col("kind") == "evidence").alias("n_evidence"), F.count_if(F.col("kind") == "value").alias("n_values"), F.count_distinct(F.when(F.col("kind") == "value", F.col("row_id"))).alias("n_rows"))


def document_scopes(segments: DataFrame, asked: FieldKind, first: int = 6) -> DataFrame:
    """doc_id, scope and confidence: what a document is about, for an entity field: of the entities that lead its
    first segments (doc_id, block_index, content) and may stand in the field, the likeliest, the earliest of
    equal ones."""
    early = segments.filter(F.col("block_index") < first).withColumn("entity", leading_entity(F.col("content")))
    good = early.filter((F.col("entity") != "") & (verdict(F.col("entity"), asked)["level"] == "accepted"))
    rated = good.withColumn("confidence", scope_confidence(F.col("block_index"), F.lit("entity_lead")))
    best = F.max_by(F.struct("entity", "confidence"), F.struct("confidence", -F.col("block_index")))
    return rated.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.entity").alias("scope"), F.col("b.confidence").alias("confidence"))


def remapped(records: DataFrame, entity: str, asked: FieldKind, scopes: DataFrame) -> DataFrame:
    """records (doc_id, the entity column, ...) with the document's scope in place of entities that speak softly
    against the field, and remapped; those that can't stand there at all, and documents without a scope, stay."""
    out = records.join(scopes.select("doc_id", "scope"), "doc_id", "left").withColumn("_level", verdict(F.col(f"`{entity}`"), asked)["level"])
    hit = F.coalesce((F.col("_level") == "soft_filter") & F.col("scope").isNotNull(), F.lit(False))
    return out.withColumn("remapped", hit).withColumn(entity, F.when(F.col("remapped"), F.col("scope")).otherwise(F.col(f"`{entity}`"))).drop("scope", "_level")
