"""The document store: Parquet tables of documents, blocks, rows, entities and task metrics.

A batch is appended under its own partition, so an import never rewrites what is there, and a
repeated import adds nothing: documents whose content hash is known are left out by an anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = "市县区省州镇"
ORGANISATION = ("公司", "集团", "企业", "机构", "局", "院", "所")
KINDS = ("documents", "text_blocks", "table_rows", "extracted_entities")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def new_documents(batch: DataFrame, known: DataFrame | None, text: str = "text") -> DataFrame:
    """The first document (by doc_id) of each content in batch that known (content_hash) lacks."""
    hashed = batch.withColumn("content_hash", content_hash(F.col(text)))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    if known is not None:
        first = first.join(known.select("content_hash"), "content_hash", "left_anti")
    return hashed.join(first, ["content_hash", "doc_id"], "left_semi")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, entity_text, entity_type and confidence of place and organisation names."""
    found = lambda pattern, low, high: F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({pattern})"), 1), lambda x: F.length(x).between(low, high))
    places = F.transform(found(f"[一-龥]{{2,6}}[{PLACE}]", 2, 8), lambda x: F.struct(x.alias("entity_text"), F.lit("location").alias("entity_type"), F.lit(0.75).alias("confidence")))
    bodies = F.transform(found(f"[一-龥]{{2,10}}(?:{'|'.join(ORGANISATION)})", 3, 15), lambda x: F.struct(x.alias("entity_text"), F.lit("organization").alias("entity_type"), F.lit(0.70).alias("confidence")))
    return docs.select("doc_id", F.inline(F.concat(places, bodies)))


def words_with_capital(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """The same for Latin script: capitalised words of at least so many letters, as candidates."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([A-Z][a-z]{{{least - 1},}})"), 1)
    return docs.select("doc_id", F.explode(found).alias("entity_text")).withColumns({"entity_type": F.lit("name"), "confidence": F.lit(0.70)})


def import_batch(docs: DataFrame, root: str, batch: str, blocks: DataFrame | None = None) -> DataFrame:
    """Append the new documents of docs (doc_id, text, ...) to the store at root; gives them back."""
    spark = docs.sparkSession
    try:
        known = spark.read.parquet(f"{root}/documents")
    except Exception as e:  # an empty store has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new_documents(docs, known).write.mode("overwrite").parquet(f"{root}/documents/batch={batch}")
    new = spark.read.parquet(f"{root}/documents/batch={batch}")
    entities(new).write.mode("overwrite").parquet(f"{root}/extracted_entities/batch={batch}")
    if blocks is not None:
        blocks.join(new.select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{root}/text_blocks/batch={batch}")
    return new


def delete_documents(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return table.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def search(tables: dict[str, tuple[DataFrame, str]], query: str, limit: int) -> DataFrame:
    """result_type, doc_id and text of rows whose text is like %query% whatever its case, a fair
    share of limit from each table, the least doc_id and text first."""
    share, out = limit // len(tables), None
    for kind, (df, column) in tables.items():
        hits = df.filter(F.col(column).ilike(f"%{query}%")).select(F.lit(kind).alias("result_type"), "doc_id", F.substring(column, 1, 200).alias("text"))
        hits = hits.orderBy("doc_id", "text").limit(share)
        out = hits if out is None else out.unionByName(hits)
    return out


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def quality_issues(issues: DataFrame, limit: int, doc: str = "source") -> DataFrame:
    """The first issues: errors, then warnings, then others, each by source, field and place."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(rank, doc, "field_name", "location", "issue_type").limit(limit)


def issue_counts(issues: DataFrame) -> DataFrame:
    """dimension, item and n: issues by type, by severity and by field, in one pass."""
    return stats(issues, ["issue_type", "severity", "field_name"])


def details(docs: DataFrame, blocks: DataFrame, found: DataFrame, first: int, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs (doc_id, ...) with n_blocks, n_entities and first_blocks, the first few of each document, and, for each name of
    more, how many rows that table has of it: the parts are aggregated before they are joined."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index"))
    shown = blocks.withColumn("place", place).filter(F.col("place") <= first)
    shown = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "content"))).alias("b")).select("doc_id", F.col("b.content").alias("first_blocks"))
    tables = {"n_blocks": blocks, "n_entities": found, **(more or {})}
    counts = [t.groupBy("doc_id").agg(F.count("*").alias(n)) for n, t in tables.items()]
    out = docs
    for part in (*counts, shown):
        out = out.join(part, "doc_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in tables})


def stats(docs: DataFrame, by: list[str]) -> DataFrame:
    """dimension, item and count for each of the columns by."""
    entries = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("item")) for c in by])
    return docs.select(F.explode(entries).alias("e")).groupBy("e.dimension", "e.item").agg(F.count("*").alias("n"))


def export_package(tables: dict[str, DataFrame], doc_id: object) -> DataFrame:
    """All rows of one document as JSON, a row for each table."""
    out = None
    for kind, df in tables.items():
        mine = df.filter(F.col("doc_id") == doc_id).agg(F.to_json(F.sort_array(F.collect_list(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))).alias("rows"))
        mine = mine.select(F.lit(kind).alias("table_name"), "rows")
        out = mine if out is None else out.unionByName(mine)
    return out


def dashboard(metrics: DataFrame, last: int = 20, rate: float = 80.0, seconds: float = 90.0) -> DataFrame:
    """Means of the last tasks (created_at, fill_rate, response_time) and whether they are in bounds."""
    recent = metrics.orderBy(F.desc("created_at"), F.desc("task_id")).limit(last)
    out = recent.agg(F.count("*").alias("n_tasks"), F.round(F.avg("fill_rate"), 4).alias("mean_fill_rate"), F.round(F.avg("response_time"), 4).alias("mean_response_time"))
    return out.withColumns({"fill_rate_ok": F.col("mean_fill_rate") >= rate, "response_time_ok": F.col("mean_response_time") <= seconds})


def upsert(metrics: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    return metrics.join(new.select(key), key, "left_anti").unionByName(new)


def source_catalog(spark: SparkSession) -> DataFrame:
    rows = [("local_file", "xlsx xls docx md txt csv json"), ("http_api", "json csv text"), ("web_page", "html_text html_table"), ("database", "sqlite")]
    return spark.createDataFrame([(t, s.split()) for t, s in rows], "source_type string, supports array<string>")
