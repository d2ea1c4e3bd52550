"""Fusion of several sources' records by entity, with conflicts found and resolved.

Claims are long-form: entity_key, field, value, source, priority, confidence, seq (the order of the
sources and rows). A later claim replaces the winner only with a greater (priority, confidence), so
the winner is the greatest by (priority, confidence, earliest): one aggregation, combined before
the shuffle. A conflict is a claim that differs from the winner before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.registry import DEFAULT, Registry
from fuseline.functions.values import clean, name_key

STRUCTURED = ("excel", "csv", "json", "database")


def cell_confidence(file_type: Column) -> Column:
    return F.when(file_type.isin(*STRUCTURED), 0.86).otherwise(0.72)


def claims_of(cells: DataFrame, keys: list[str], registry: Registry = DEFAULT) -> DataFrame:
    """Claims of typed cells of one table; keys are the headers that name the entity."""
    filled = cells.filter(clean(F.col("value")) != "")
    entry = F.when(F.col("header").isin(*keys), F.struct("col_index", name_key(F.col("value")).alias("k")))
    named = filled.groupBy("source", "table_index", "row_id").agg(F.array_sort(F.collect_list(entry)).alias("ks"))
    named = named.select("source", "table_index", "row_id", F.concat_ws("|", F.transform("ks", lambda x: x["k"])).alias("own"))
    key = F.when(F.col("own") != "", F.col("own")).otherwise(F.concat_ws("#", "source", F.col("table_index").cast("string"), "row_id"))
    headers = [r[0] for r in cells.select("header").distinct().collect()]  # as many as columns
    canon = F.create_map(*[x for h in headers for x in (F.lit(h), F.lit(registry.canonical_name(h) or name_key_of(h)))]) if headers else F.create_map()
    return filled.join(named, ["source", "table_index", "row_id"]).select(key.alias("entity_key"), F.try_element_at(canon, F.col("header")).alias("field"), F.col("typed.standard_value").alias("value"), "source", "priority", cell_confidence(F.col("file_type")).alias("confidence"), F.struct("source", "table_index", "row_id").alias("seq"))


def name_key_of(header: str) -> str:
    from fuseline.functions.registry import name_key as key

    return key(header)


def fuse(claims: DataFrame) -> DataFrame:
    """entity_key, field, value, winner (source), n_claims, n_sources; seq must be a number."""
    best = F.max_by(F.struct("value", "source"), F.struct("priority", "confidence", -F.col("seq")))
    out = claims.groupBy("entity_key", "field").agg(best.alias("best"), F.count("*").alias("n_claims"), F.count_distinct("source").alias("n_sources"))
    return out.select("entity_key", "field", F.col("best.value").alias("value"), F.col("best.source").alias("winner"), "n_claims", "n_sources")


#: Numbers of seq that are one stretch of a key's claims.
STRETCH = 100_000


def conflicts(claims: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """entity_key, field, left_value (the winner so far) and right_value of each conflict.

    A key's claims are taken in stretches of seq. Each stretch's winner is found by an aggregation, the winner before a stretch is the greatest of
    the few before it, and only within a stretch claims are gone through in order, so a hot key is many tasks'."""
    keys = ["entity_key", "field", "stretch"]
    rank = F.struct("priority", "confidence", (-F.col("seq")).alias("order"), "value")
    rows = claims.withColumn("stretch", F.floor(F.col("seq") / stretch))
    best = rows.groupBy(keys).agg(F.max(rank).alias("own"))
    earlier = Window.partitionBy("entity_key", "field").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("held", F.max("own").over(earlier)).filter("held IS NOT NULL").select(*keys, "held")
    before = Window.partitionBy(keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(best, keys, "left").withColumn("left", F.greatest("held", F.max(rank).over(before))).filter(F.col("left").isNotNull())
    differ = name_key(F.col("left.value")) != name_key(F.col("value"))
    return rows.filter(differ).select("entity_key", "field", F.col("left.value").alias("left_value"), F.col("value").alias("right_value"), "source")


def fusion_summary(claims: DataFrame) -> DataFrame:
    """Raw records (entity and source), fused records, merged duplicates and conflicts, as one row."""
    records = claims.select("entity_key", "source").distinct()
    counts = records.groupBy("entity_key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("raw_records"), F.count("*").alias("fused_records"))
    found = conflicts(claims).agg(F.count("*").alias("conflict_count"))
    return counts.join(F.broadcast(found), F.lit(True)).select("raw_records", "fused_records", (F.col("raw_records") - F.col("fused_records")).alias("duplicates_merged"), "conflict_count")
