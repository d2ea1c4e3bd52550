"""Merging of records whose values, confidences and evidence are maps by field.

A record's fields become rows, which are combined before the shuffle and again after it; what is kept of a field is the winner,
a runner-up and the first few pieces of evidence, so neither a hot record nor a hot field is gathered. At last each record's few
fields become maps again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.values import clean, name_key

EVIDENCE = 5


def first_distinct(rows: DataFrame, keys: Sequence[str], value: Column, order: Column, k: int, name: str) -> DataFrame:
    """keys and, under name, each key's first k different values in the order of their first places. Equal values meet
    before the shuffle, then each task keeps a key's k first ones, and only these are put together."""
    one = rows.groupBy(*keys, value.alias("_value")).agg(F.min(order).alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_value"))
    few = one.filter(F.col("_value").isNotNull()).withColumn("_place", place).filter(F.col("_place") <= k)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "_value")))["_value"].alias(name))


def merge_maps(records: DataFrame, key: str, order: str, gap: float = 0.08, evidence: int = EVIDENCE) -> DataFrame:
    """One record for each key: values, confidences (the greatest), value_sources, evidence (the first different ones, up
    to a number), methods and needs_review.

    records: the key, an order, source_file, values (map of texts), confidences (map of doubles), evidence (map of arrays of
    texts) and methods (map of texts). A field's value is the one of the greatest confidence, the first of equal ones; blank ones
    never win, and no confidence is less than any. needs_review: the fields for which a different value, apart from spelling, of
    another source is within gap. Records with a null key stay each for itself."""
    own = F.struct(F.col(key).alias("k"), F.when(F.col(key).isNull(), F.col(order)).alias("o"))
    fields = F.array_union(F.array_union(F.map_keys("values"), F.coalesce(F.map_keys("confidences"), F.array())), F.coalesce(F.map_keys("evidence"), F.array()))
    rows = records.select(own.alias("id"), F.col(order).alias("at"), "source_file", "values", "confidences", "evidence", "methods", F.explode(fields).alias("field"))
    of = lambda m: F.try_element_at(F.col(m), F.col("field"))
    rows = rows.select("id", "at", "source_file", "field", clean(of("values")).alias("value"), of("confidences").alias("conf"), of("evidence").alias("shown"), of("methods").alias("method"))
    keys = ["id", "field"]
    # each different value of a field once, then the two best: what is left of a field is two rows
    per_value = rows.filter("value <> ''").groupBy(*keys, "value").agg(F.max(F.struct(F.coalesce("conf", F.lit(-1.0)).alias("conf"), (-F.col("at")).alias("at"), F.col("source_file").alias("source"))).alias("best"))
    spelt = per_value.groupBy(*keys, name_key(F.col("value")).alias("spelling")).agg(F.max(F.struct("best", "value")).alias("b"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("b.best.conf"), F.desc("b.best.at")))
    two = spelt.withColumn("place", place).filter("place <= 2").groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col("b"))).alias("won"), F.max(F.when(F.col("place") == 2, F.col("b"))).alias("next"))
    review = (F.col("next.best.conf") > F.col("won.best.conf") - gap) & (F.col("next.best.source") != F.col("won.best.source")) & (F.col("next.best.conf") >= 0)
    facts = rows.groupBy(*keys).agg(F.max("conf").alias("conf"), F.min_by("method", F.when(F.coalesce("method", F.lit("")) != "", F.col("at"))).alias("method"))
    shown = first_distinct(rows.select(*keys, "at", F.posexplode("shown").alias("p", "piece")), keys, F.col("piece"), F.struct("at", "p"), evidence, "shown")
    sources = first_distinct(rows.join(two.select(*keys, F.col("won.value").alias("w")), keys).filter("value = w"), keys, F.col("source_file"), F.col("at"), evidence, "sources")
    whole = facts.join(two, keys, "left").join(shown, keys, "left").join(sources, keys, "left")
    part = lambda value, has=None: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.lit(True) if has is None else has, F.struct("field", value)))))
    won = F.col("won.value")
    out = whole.groupBy("id").agg(
        part(won.alias("v"), won.isNotNull()).alias("values"), part(F.col("conf"), F.col("conf").isNotNull()).alias("confidences"), part(F.col("shown"), F.col("shown").isNotNull()).alias("evidence"),
        part(F.col("sources"), F.col("sources").isNotNull()).alias("value_sources"), part(F.col("method"), F.col("method").isNotNull()).alias("methods"), F.array_sort(F.collect_list(F.when(review, F.col("field")))).alias("needs_review"),
    )
    n = records.groupBy(own.alias("id")).agg(F.count("*").alias("n_merged"), F.min(order).alias(order))
    none = lambda c, kind: F.coalesce(c, F.map_from_arrays(F.array(), F.array()).cast(kind))
    kinds = {"values": "map<string,string>", "confidences": "map<string,double>", "evidence": "map<string,array<string>>", "value_sources": "map<string,array<string>>", "methods": "map<string,string>"}
    joined = n.join(out, "id", "left")
    return joined.select(F.col("id.k").alias(key), order, "n_merged", *[none(F.col(c), kind).alias(c) for c, kind in kinds.items()], F.coalesce("needs_review", F.array().cast("array<string>")).alias("needs_review"))


def split_by_quality(records: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """records with quality_flags, the names of the reasons that hold, in the given order, and stable: none does.
    Records are judged once, and those that stay and those for review are two filters of it."""
    flags = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in reasons.items()]), lambda x: x.isNotNull())
    return records.withColumn("quality_flags", flags if reasons else F.array().cast("array<string>")).withColumn("stable", F.size("quality_flags") == 0)
