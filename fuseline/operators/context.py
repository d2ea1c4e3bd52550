"""What a template's table is about, and which records and sources speak of the same.

A table's context are the words of the template's name, its first headings, and the text between the table before and it. Records
taken from text that speak of something else, or whose values contradict a hint such as "City: Nanjing", are dropped, each with its
first reason; sources are ranked by how much of the context they have."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.automaton import words_in
from fuseline.functions.values import clean, let
from fuseline.operators.mapping import match_headers
from fuseline.operators.narrative import stem
from fuseline.operators.pairing import bare

# Words that tell nothing of a topic, parts of such words, and words of each domain.
GENERIC = "数据 信息 报告 模板 情况 要求 说明 结果 来源 统计 表格 字段 指标 文件 任务 内容 分析 中国 全国 全省 全市 城市 地区 国家 省份".split()
GENERIC_PARTS = "模板 报告 数据 信息 统计 公报 情况 说明 结果 来源 sheet table doc xlsx docx txt md".split()
DOMAIN_WORDS = {
    "economy": "gdp 生产总值 经济 财政 预算 收入 支出 人口 人均 工业 投资".split(),
    "air_quality": "aqi 空气 环境 质量 pm2 pm10 so2 no2 co o3 污染".split(),
    "epidemic": "covid 疫情 确诊 死亡 康复 病例 感染 检测 新冠".split(),
}
FULL_HINTS = "时间 日期 年份 月份 城市 地区 国家 名称 类型 类别".split()
#: Longest value of a hint under another name than FULL_HINTS.
HINT = 32


def topic_words(c: Column) -> Column:
    """The different topic words of a text: runs of Latin letters or of ideographs, less those that tell nothing; of long runs
    of ideographs their parts of up to eight as well."""
    low = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z]{2,20}|[一-龥]{2,24})"), 1), F.lower)
    words = F.filter(low, lambda w: ~w.isin(GENERIC))
    long_ = F.filter(words, lambda w: w.rlike("^[一-龥]{8,24}$"))
    parts = F.flatten(F.transform(long_, lambda w: F.regexp_extract_all(w, F.lit("([一-龥]{2,8})"), 1)))
    dull = lambda w: w.isin(GENERIC) | ((F.length(w) <= 4) & w.rlike("|".join(GENERIC_PARTS)))
    return F.array_distinct(F.concat(words, F.filter(parts, lambda w: ~dull(w))))


def topic_domains(words: Column) -> Column:
    """The domains one of whose words some topic word contains."""
    hit = lambda of: F.exists(words, lambda w: w.rlike("|".join(of)))
    return F.filter(F.array(*[F.when(hit(of), F.lit(d)) for d, of in DOMAIN_WORDS.items()]), lambda d: d.isNotNull())


def filter_hints(c: Column) -> Column:
    """A map of the "name: value" lines of a text; of lines with the same name the last."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "[\n；;]+"), clean)
    form = "^([^：:\\s]{1,20})[：:]\\s*([^：:]{1,40})$"
    pairs = F.transform(lines, lambda x: F.struct(clean(F.regexp_extract(x, form, 1)).alias("key"), clean(F.regexp_extract(x, form, 2)).alias("value")))
    good = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & (p["key"].isin(FULL_HINTS) | (F.length(p["value"]) <= HINT)))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + F.lit(2), F.greatest(F.size(good), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def descriptions(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, position of each of tables (doc_id, position) and description: the contents of the blocks (doc_id, position,
    content) above it and below the table before it, joined by new lines. A block goes to the next table below it,
    found in one pass over the document from its end; blocks below the last table go to none."""
    both = blocks.select("doc_id", "position", "content").unionByName(tables.select("doc_id", "position", F.lit(None).cast("string").alias("content")).withColumn("table", F.col("position")), allowMissingColumns=True)
    up = Window.partitionBy("doc_id").orderBy(F.desc("position"), F.col("table").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("below", F.last("table", ignorenulls=True).over(up)).filter("below IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.when(F.col("table").isNull(), F.struct("position", "content"))))
    return placed.groupBy("doc_id", F.col("below").alias("position")).agg(parts.alias("parts")).select("doc_id", "position", F.concat_ws("\n", "parts.content").alias("description"))


def table_contexts(documents: DataFrame, blocks: DataFrame, tables: DataFrame, asked: str = "") -> DataFrame:
    """doc_id, position, description, anchor_words and anchor_domains (of the document's name, the description and the first two headings),
    topic_words and topic_domains (of the headers and the asked text as well) and hints, for each of tables (doc_id,
    position, headers). documents: doc_id, name. blocks: doc_id, position, content, heading_level."""
    head = blocks.filter("heading_level > 0").select("doc_id", F.struct("position", "content").alias("h"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    heads = head.withColumn("k", nth).filter("k <= 2").groupBy("doc_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("h"))["content"]).alias("heads"))
    rows = tables.select("doc_id", "position", "headers").join(descriptions(blocks, tables), ["doc_id", "position"]).join(documents.select("doc_id", stem(F.col("name")).alias("stem")), "doc_id", "left").join(heads, "doc_id", "left")
    anchor = F.concat_ws(" ", "stem", "description", "heads")
    rows = rows.withColumn("anchor_words", topic_words(anchor)).withColumn("topic_words", topic_words(F.concat_ws(" ", anchor, F.concat_ws(" ", "headers"), F.lit(asked))))
    return rows.select("doc_id", "position", "description", "anchor_words", topic_domains(F.col("anchor_words")).alias("anchor_domains"), "topic_words", topic_domains(F.col("topic_words")).alias("topic_domains"), filter_hints(F.col("description")).alias("hints"))


def loosely_equal(actual: Column, expected: Column) -> Column:
    """The same date however its parts are joined, or, without blanks and marks, the same text or one within the other."""
    date = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\.0$", ""), "[/.]", "-")
    a, b = bare(actual), bare(expected)
    return (actual == "") | (expected == "") | (date(actual) == date(expected)) | F.contains(a, b) | F.contains(b, a)


def _headers_of_hints(rows: DataFrame) -> DataFrame:
    """keys, columns and header: for each hint's name the column it means, worked out once for each different pair of
    hint names and columns, of which there are few."""
    kinds = rows.select("keys", "columns").distinct()

    @F.arrow_udf("array<string>")
    def best(keys: pa.Array, columns: pa.Array) -> pa.Array:
        meant = lambda k, columns: next((found for _, found, _ in match_headers([k], columns)), None)
        return pa.array([[meant(k, c) for k in ks] for ks, c in zip(keys.to_pylist(), columns.to_pylist(), strict=True)], pa.list_(pa.string()))

    return kinds.withColumn("meant", best("keys", "columns"))


def with_context(records: DataFrame, contexts: DataFrame) -> DataFrame:
    """records with reason: "" for those that stay, else template_topic_mismatch or template_filter_mismatch.

    records: record_id, template, source_file, narrative, snippets (array, the first piece of evidence of each field),
    n_backed (fields with a value and evidence), values (map). contexts: template, anchor_words, anchor_domains, topic_words,
    topic_domains, hints. A record meets its template's context in one equi-join, whatever the number of templates; one whose template
    has no context stays."""
    name = stem(F.col("source_file"))
    text = F.concat_ws(" ", name, F.transform("snippets", lambda s: F.substring(s, 1, 180)))
    c = contexts.select("template", "anchor_words", "anchor_domains", "topic_words", "topic_domains", "hints")
    rows = records.join(c, "template", "left").withColumns({"_own": topic_words(name), "_words": topic_words(text)})
    rows = rows.withColumns({"_own_domains": topic_domains(F.col("_own")), "_domains": topic_domains(F.col("_words"))})
    some = lambda a: F.size(a) > 0
    apart = lambda a, b: some(a) & some(b) & ~F.arrays_overlap(a, b)
    col = F.col
    topic = (
        F.when(~col("narrative") | (F.size("topic_words") == 0), True)
        .when(F.arrays_overlap("anchor_words", "_own") | F.arrays_overlap("anchor_words", "_words"), True)
        .when(apart(col("anchor_domains"), col("_own_domains")), False)
        .when(F.arrays_overlap("topic_words", "_words"), True)
        .when(apart(col("topic_domains"), col("_domains")), False)
        .when(some(col("topic_domains")) & ~some(col("_domains")), True)
        .otherwise(col("n_backed") >= F.greatest(F.lit(2), F.least(F.lit(3), F.size("values"))))
    )
    # The order in which a map holds its keys says nothing; the sorted ones are the same for all records of a kind.
    rows = rows.withColumns({"_topic": topic, "keys": F.array_sort(F.map_keys("hints")), "columns": F.array_sort(F.map_keys("values"))})
    meant = _headers_of_hints(rows.filter(F.size("keys") > 0))
    rows = rows.join(meant, ["keys", "columns"], "left")
    against = F.exists(F.arrays_zip("keys", "meant"), lambda p: p["meant"].isNotNull() & ~loosely_equal(clean(F.try_element_at("values", p["meant"])), F.try_element_at("hints", p["keys"])))
    reason = F.when(~col("_topic"), "template_topic_mismatch").when(F.coalesce(against, F.lit(False)), "template_filter_mismatch").otherwise("")
    known = col("topic_words").isNotNull()
    return rows.withColumn("reason", F.when(known, reason).otherwise("")).select(*records.columns, "reason")


def context_losses(checked: DataFrame) -> DataFrame:
    """source_file, remaining, dropped and reasons (a map of counts) of records with reason."""
    each = checked.groupBy("source_file", "reason").agg(F.count("*").alias("n"))
    lost = F.filter(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: x["reason"] != "")
    sums = [F.coalesce(F.sum(F.when((F.col("reason") == "") == stays, F.col("n"))), F.lit(0)).alias(c) for c, stays in (("remaining", True), ("dropped", False))]
    return each.groupBy("source_file").agg(*sums, F.map_from_entries(lost).alias("reasons"))


def source_scores(sources: DataFrame, contexts: DataFrame, k: int | None = 4) -> DataFrame:
    """template, source, score, n_indicators, n_entities: how well sources suit templates, the k best of each (all: None), by name where equal.

    sources: source, title, body (the head of its text), n_signals (of its first blocks, those with a number or a leading
    entity). contexts: template, topic_words, indicators and entities (arrays of terms). What a source has of the words
    of all templates is found in one pass over its text; pairs come from an equi-join on that, so sources
    meet only templates of which they have something. Pairs with nothing in common have no score."""
    ready = lambda c: F.filter(F.array_distinct(F.transform(c, bare)), lambda w: (F.length(w) >= 2) & ~w.isin(GENERIC))
    kinds = {"word": F.col("topic_words"), "indicator": ready("indicators"), "entity": ready("entities")}
    terms = contexts.select("template", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), words.alias("words")) for kind, words in kinds.items()])).alias("x")).select("template", "x.kind", F.explode("x.words").alias("term"))
    asked = [r[0] for r in terms.filter("kind <> 'word'").select("term").distinct().collect()]  # the templates' own, few
    found = lambda c: words_in(bare(F.col(c)), asked)
    place = lambda kind, name, words: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("place"), words.alias("words"))
    seen = sources.select("source", F.explode(F.array(*[place("word", p, topic_words(F.col(p))) for p in ("title", "body")], *[place("term", p, found(p)) for p in ("title", "body")])).alias("x"))
    seen = seen.select("source", "x.kind", "x.place", F.explode("x.words").alias("term")).withColumnRenamed("kind", "_as")
    met = seen.join(terms, (seen["term"] == terms["term"]) & ((terms["kind"] == "word") == (seen["_as"] == "word"))).select("source", "template", "kind", "place", terms["term"].alias("term"))
    best = met.groupBy("source", "template", "kind", "term").agg(F.max("place").alias("place"))  # the title comes last in the alphabet
    n = lambda kind, p=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if p is None else F.col("place") == p))
    sums = best.groupBy("source", "template").agg(n("word", "title").alias("wt"), n("word", "body").alias("wb"), n("indicator", "title").alias("it"), n("indicator").alias("n_indicators"), n("entity", "title").alias("et"), n("entity").alias("n_entities"))
    sums = sums.join(sources.select("source", "n_signals"), "source").join(contexts.select("template", (F.size("topic_words") > 0).alias("wordy")), "template")
    c = F.col
    score = F.when(c("wt") > 0, 5 + F.least(c("wt"), F.lit(4))).when(c("wb") > 0, 3 + F.least(c("wb"), F.lit(3))).when(c("wordy"), -1).otherwise(0)
    score = score + 3 * c("it") + 2 * (c("n_indicators") - c("it")) + 3 * c("et") + (c("n_entities") - c("et"))
    score = score + F.when(c("n_indicators") >= 2, 2).otherwise(0) + F.when((c("n_indicators") > 0) & (c("n_entities") > 0), 1).otherwise(0)
    last = let(score, lambda s: F.when(s >= 3, s).when((c("n_signals") >= 3) & (c("n_indicators") >= 1), s + 2).when(c("n_signals") >= 4, s + 1).otherwise(s))
    out = sums.select("template", "source", last.cast("long").alias("score"), "n_indicators", "n_entities")
    if k is None:
        return out
    place_ = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("score"), "source"))
    return out.withColumn("place", place_).filter(F.col("place") <= k)
