"""Records: first-wins dedup, merging by entity, confidence.

"The first" is by an explicit order, never by where rows lie. Dedup and merging are aggregations
that combine before the shuffle, not windows over a key's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.headers import header_date
from fuseline.functions.values import clean, name_key

#: Fixed: endings that an entity's name may lack.
ENTITY_SUFFIXES = ("特别行政区", "自治区", "自治州", "省", "市", "区", "县")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is least by order, and n_merged, the key's rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in [*order, *[r for r in rest if r not in order]]])
    out = df.groupBy(*keys).agg(F.min(row).alias("r"), F.count("*").alias("n_merged"))
    return out.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "n_merged")


def visible_key(columns: Sequence[str]) -> Column:
    """What two narrative records must share to be one: their visible values."""
    return F.concat_ws("\x1f", *[clean(F.col(c)) for c in columns])


def dedup_records(records: DataFrame, headers: Sequence[str], order: str, row_identity: Sequence[str]) -> DataFrame:
    """records with one of each identity: rows of tables are themselves (source_file and
    row_identity), others are their values. Evidence (array) is united, confidence the greatest."""
    table = F.col(row_identity[0]).isNotNull()
    own = F.concat_ws("\x1f", F.lit("row"), "source_file", *[F.col(c).cast("string") for c in row_identity])
    key = F.when(table, own).otherwise(F.concat_ws("\x1f", F.lit("values"), visible_key(headers)))
    rows = records.withColumn("record_key", key)
    # equal pieces of evidence meet before any are put together, so that a key with many copies is no long list
    pieces = rows.select("record_key", order, F.posexplode("evidence").alias("_p", "_piece"))
    once = pieces.groupBy("record_key", "_piece").agg(F.min(F.struct(order, "_p")).alias("_at"))
    shown = once.groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece")))["_piece"].alias("evidence"))
    agg = [F.min_by(h, order).alias(h) for h in headers]
    out = rows.groupBy("record_key").agg(F.min(order).alias(order), *agg, F.max("confidence").alias("confidence"), F.count("*").alias("n_merged"))
    out = out.join(shown, "record_key", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return out.select("record_key", order, *headers, "evidence", "confidence", "n_merged")


def entity_key(c: Column) -> Column:
    return F.regexp_replace(name_key(c), f"(?:{'|'.join(ENTITY_SUFFIXES)})$", "")


def _has(v: str) -> Column:
    return F.col(v).isNotNull() & (F.col(v).cast("string") != "")


def resolve(values: Sequence[str], order: str) -> list[Column]:
    """For each value column v (with v_conf): the value of the most confident record that has one,
    the first of equal ones, and its confidence."""
    out = []
    for v in values:
        out.append(F.max_by(F.when(_has(v), F.col(v)), F.when(_has(v), F.struct(F.col(f"{v}_conf"), -F.col(order)))).alias(v))
        out.append(F.max(F.when(_has(v), F.col(f"{v}_conf"))).alias(f"{v}_conf"))
    return out


def contested(records: DataFrame, key: str, values: Sequence[str], gap: float = 0.08) -> DataFrame:
    """key and needs_review, the value columns of which a second spelling is within gap of the most confident one. Each
    spelling's greatest confidence, then the two greatest of these are kept of a field, however many records a key has."""
    claims = [F.when(_has(v), F.struct(F.lit(i).alias("i"), F.lit(v).alias("field"), F.col(f"{v}_conf").cast("double").alias("conf"), name_key(F.col(v).cast("string")).alias("spelling"))) for i, v in enumerate(values)]
    long = records.select(key, F.explode(F.filter(F.array(*claims), lambda c: c.isNotNull())).alias("c")).select(key, "c.*")
    spelt = long.groupBy(key, "i", "field", "spelling").agg(F.max("conf").alias("conf"))
    place = F.row_number().over(Window.partitionBy(key, "i", "field").orderBy(F.desc_nulls_last("conf")))
    two = spelt.withColumn("place", place).filter("place <= 2").groupBy(key, "i", "field").agg(F.max("conf").alias("top"), F.max(F.when(F.col("place") == 2, F.col("conf"))).alias("next"))
    close = two.filter(F.col("next") > F.col("top") - gap)
    return close.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "field")))["field"].alias("needs_review"))


def semantic_merge(records: DataFrame, entity: str, values: Sequence[str], order: str, date: str | None = None, gap: float = 0.08) -> DataFrame:
    """One record for each entity (endings and spelling apart) and date: blanks are filled, of
    different values the more confident stays. needs_review lists the fields in which another
    spelling is within gap of the winner's confidence; records without key stay themselves."""
    key = entity_key(F.col(entity))
    parts = [key] + ([F.col(date).cast("string")] if date else [])
    named = F.concat_ws("|", *parts)
    whole = F.when(named == "", F.concat(F.lit("#"), F.col(order).cast("string"))).otherwise(named)
    rows = records.withColumn("record_key", whole)
    out = rows.groupBy("record_key").agg(F.min_by(entity, order).alias(entity), *resolve(values, order), F.count("*").alias("n_merged"), F.array_sort(F.collect_set("source_file")).alias("sources"))
    out = out.join(contested(rows, "record_key", values, gap), "record_key", "left")
    return out.withColumn("needs_review", F.coalesce("needs_review", F.array().cast("array<string>")))


def table_confidence(match: Column, coverage: Column, value: Column, offset: Column | float = 0.0) -> Column:
    """Confidence of a table's cell by how its header matched (exact, containment, approx, weak or
    none), the share of headers that matched and the value; fixed constants of the model."""
    base = {"exact": (0.91, 0.90, 0.98), "containment": (0.84, 0.58, 0.89), "approx": (0.76, 0.70, 0.85), "weak": (0.70, 0.70, 0.79)}
    text = clean(value)
    quality = 0.68 + F.least(F.lit(0.26), coverage * 0.26)
    lift = F.greatest(F.lit(-0.03), F.least(F.lit(0.03), (quality - 0.76) * 0.18)) + F.least(F.lit(0.02), F.length(text) * 0.001) + F.when(text.rlike(r"\d"), 0.01).otherwise(0.0) - F.when(F.length(text) == 1, 0.05).otherwise(0.0) + offset
    out = F.round(F.greatest(F.lit(0.58), F.least(F.lit(0.69), 0.58 + lift)), 4)
    for name, (b, low, high) in base.items():
        out = F.when(match == name, F.round(F.greatest(F.lit(low), F.least(F.lit(high), b + lift)), 4)).otherwise(out)
    return out


def match_band(a: Column, b: Column, ratio: Column) -> Column:
    """How two headers match: exact, containment, or by their ratio approx, weak or none."""
    return F.when(a == b, "exact").when(F.contains(a, b) | F.contains(b, a), "containment").when(ratio >= 0.78, "approx").when(ratio >= 0.58, "weak").otherwise("none")


def confidence_by_column(cells: DataFrame) -> DataFrame:
    """field and its mean confidence over cells that have a value."""
    return cells.filter(clean(F.col("value")) != "").groupBy("field").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count("*").alias("n_cells"))


def complementary(a: str, b: str, headers: Sequence[str], table_backed: str | None = None, when: str | None = None) -> Column:
    """Whether two records (structs a and b) of one source may be one: neither is a table's row, their times don't
    differ, they fill each other's blanks or share a value, and at most one value differs. headers: those that
    aren't the key."""
    pairs = [(clean(F.col(f"{a}.{h}")), clean(F.col(f"{b}.{h}"))) for h in headers]
    count = lambda test: sum((F.when(test(x, y), 1).otherwise(0) for x, y in pairs), F.lit(0))
    fills = count(lambda x, y: (x == "") != (y == ""))
    shared, conflicts = count(lambda x, y: (x != "") & (x == y)), count(lambda x, y: (x != "") & (y != "") & (x != y))
    out = (conflicts < 2) & ((fills > 0) | (shared > 0))
    if when:
        x, y = header_date(F.col(f"{a}.{when}")), header_date(F.col(f"{b}.{when}"))
        out &= (x == "") | (y == "") | (F.lower(x) == F.lower(y))
    if table_backed:
        out &= ~(F.coalesce(F.col(f"{a}.{table_backed}"), F.lit(False)) | F.coalesce(F.col(f"{b}.{table_backed}"), F.lit(False)))
    return out


def scope_confidence(rank: Column, method: Column) -> Column:
    """Confidence of a value from a document's scope by its segment's rank (from 0) and how it was found;
    fixed constants of the model."""
    lift = F.when(method.isin("text_context", "text_exact"), 0.08).when(method == "entity_lead", 0.03).otherwise(0.0)
    first = F.when(rank == 0, 0.06).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.52), F.least(F.lit(0.82), 0.66 - F.least(rank, F.lit(4)) * 0.04 + lift + first)), 4)


#: Fixed: a cell's confidence by its table's method, where neither its record nor its column has one.
BY_METHOD = {"rule": 0.76, "llm": 0.54, "llm_multi": 0.57, "qwen": 0.54, "qwen_multi": 0.57, "qwen_narrative": 0.58}


def cell_confidence(value: Column, n_evidence: Column, own: Column, column: Column, method: Column) -> Column:
    """A filled cell's confidence: its record's, its column's mean, or its method's; none without value or
    evidence."""
    default = F.when(method == "none", F.lit(None).cast("double")).otherwise(0.60)
    for name, c in BY_METHOD.items():
        default = F.when(method == name, c).otherwise(default)
    return F.when((F.coalesce(value, F.lit("")) != "") & (F.coalesce(n_evidence, F.lit(0)) > 0), F.coalesce(own, column, default))
