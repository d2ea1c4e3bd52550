"""Which source tables can fill which template tables.

Tables are rows of (name, headers); there may be very many sources. What two tables share is found by an
equi-join on their header words and the concepts behind them, so no pair is made that shares nothing;
rules over the pair's few sets decide, and headers are matched for pairs that are left."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.operators.mapping import match_headers, usable

# Words in headers that tell what a table is about.
CONCEPTS = {
    "entity": "城市 城市名 城市名称 国家 地区 名称 省 省份 区域 站点 单位 country city region province name station".split(),
    "time": "日期 时间 年月 年份 月份 监测时间 date time year month".split(),
    "economy": "gdp 生产总值 经济 财政 预算 收入 支出 工业 投资 消费 人口 人均 增速 亿元 万人".split(),
    "air_quality": "aqi 空气 环境 质量 pm2.5 pm10 so2 no2 co o3 污染".split(),
    "epidemic": "covid 疫情 确诊 死亡 康复 病例 感染 患者 核酸 检测 新冠 confirmed deaths recovered cases tests".split(),
}
DOMAINS = ("economy", "air_quality", "epidemic")
MARKS = r"[\s_\-:：,，、/\\()（）\[\]【】]+"


def bare(header: Column) -> Column:
    """A header in lower case without blanks and marks."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), MARKS, "")


def header_words(headers: Column) -> Column:
    """The different words of a table's headers, of at least two characters."""
    found = F.flatten(F.transform(headers, lambda h: F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit("([A-Za-z0-9.]+|[一-龥]{2,12})"), 1)))
    return F.array_distinct(F.filter(F.transform(found, bare), lambda w: F.length(w) >= 2))


def header_concepts(headers: Column) -> Column:
    """The concepts one of whose words a header contains."""
    keys = F.transform(headers, bare)
    has = lambda words: F.exists(keys, lambda h: h.rlike("|".join(re.escape(w) for w in words)))
    return F.filter(F.array(*[F.when(has(words), F.lit(c)) for c, words in CONCEPTS.items()]), lambda c: c.isNotNull())


def described(tables: DataFrame) -> DataFrame:
    """tables (name, headers) that have a header, with words and concepts."""
    named = tables.withColumn("headers", F.filter("headers", lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")).filter(F.size("headers") > 0)
    return named.withColumns({"words": header_words(F.col("headers")), "concepts": header_concepts(F.col("headers"))})


def _plausible_kinds(templates: DataFrame, sources: DataFrame) -> DataFrame:
    """wanted, found (headers) and how many words and concepts they share, of the different header rows of the tables that
    may be about the same. Very many tables have few of these, and all rules are worked out on them alone."""

    def items(tables: DataFrame, name: str) -> DataFrame:
        both = F.concat(F.transform("words", lambda w: F.concat(F.lit("word:"), w)), F.transform("concepts", lambda c: F.concat(F.lit("concept:"), c)))
        domains = F.array_intersect("concepts", F.array(*map(F.lit, DOMAINS)))
        kinds = tables.select(F.col("headers").alias("name"), "headers").distinct()
        return described(kinds).select(F.col("name").alias(name), domains.alias(f"{name}_domains"), F.explode(both).alias("item"))

    met = items(sources, "found").join(items(templates, "wanted"), "item")
    word = F.col("item").startswith("word:")
    pairs = met.groupBy("wanted", "found", "wanted_domains", "found_domains").agg(F.count_if(word).alias("shared_words"), F.count_if(~word).alias("shared_concepts"))
    own, theirs = F.col("wanted_domains"), F.col("found_domains")
    # whatever is shared will do once the domains agree; without words it's a concept, of which any will do
    return pairs.filter((F.size(own) == 0) | F.arrays_overlap(own, theirs)).select("wanted", "found", "shared_words", "shared_concepts")


def _of_kinds(templates: DataFrame, sources: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds with the names of the tables that have these headers."""
    named = kinds.join(templates.select(F.col("name").alias("template"), F.col("headers").alias("wanted")), "wanted")
    return named.join(sources.select(F.col("name").alias("source"), F.col("headers").alias("found")), "found")


def plausible_pairs(templates: DataFrame, sources: DataFrame) -> DataFrame:
    """template, source and how many words and concepts they share, of pairs of tables (name, headers)
    about the same thing: a template of some domain takes sources of one of its domains only, and any
    pair must share a word, an entity or time column, or a domain."""
    return _of_kinds(templates, sources, _plausible_kinds(templates, sources)).select("template", "source", "shared_words", "shared_concepts")


def table_candidates(templates: DataFrame, sources: DataFrame) -> DataFrame:
    """template, source, mapping (of template_header, source_header, score) and confidence, the share of
    matched headers, of plausible pairs whose mapping can be used."""
    full = lambda c: F.filter(c, lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")
    kinds = _plausible_kinds(templates, sources).withColumns({"w": full("wanted"), "f": full("found")})
    shape = pa.list_(pa.struct([("template_header", pa.string()), ("source_header", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<template_header: string, source_header: string, score: double>>")
    def mapping(wanted: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for w, f in zip(wanted.to_pylist(), found.to_pylist(), strict=True):
            got = match_headers(w, f)
            out.append([dict(zip(("template_header", "source_header", "score"), p, strict=True)) for p in got] if usable(w, got) else [])
        return pa.array(out, shape)

    mapped = kinds.withColumn("mapping", mapping("w", "f")).filter(F.size("mapping") > 0)
    mapped = mapped.select("wanted", "found", "mapping", F.round(F.size("mapping") / F.size("w"), 4).alias("confidence"))
    return _of_kinds(templates, sources, mapped).select("template", "source", "mapping", "confidence")


def ranked_evidence(templates: DataFrame, sources: DataFrame, rows: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """template, source, rank, confidence, row_no and values of the rows of sources that can fill templates: rank is one more than the
    template's candidates of greater confidence, values a map by the template's headers, and keep tells of
    it which rows stay. rows: source, row_no, values (a map by the source's headers). Candidates without rows that stay have none here."""
    found = table_candidates(templates, sources)
    steps = found.groupBy("template", "confidence").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("template").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = steps.select("template", "confidence", (F.coalesce(above, F.lit(0)) + 1).alias("rank"))
    under = F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["template_header"], F.try_element_at("own", m["source_header"]))))
    out = found.join(ranks, ["template", "confidence"]).join(rows.select("source", "row_no", F.col("values").alias("own")), "source").withColumn("values", under)
    return (out.filter(keep(F.col("values"))) if keep else out).select("template", "source", "rank", "confidence", "row_no", "values")


def text_evidence(blocks: DataFrame, fields: list[str], least: float = 0.3) -> DataFrame:
    """field, doc_id, block_index, confidence: blocks (doc_id, block_index, content) that have at least such
    a share of a field name's words."""
    words = lambda f: F.regexp_extract_all(F.lit(f), F.lit("([一-龥a-zA-Z0-9]+)"), 1)
    share = lambda f: F.size(F.filter(words(f), lambda w: F.contains(F.col("content"), w))) / F.greatest(F.size(words(f)), F.lit(1))
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.round(share(f), 4).alias("confidence")) for f in fields]))
    return blocks.select("doc_id", "block_index", found.alias("f")).select("f.field", "doc_id", "block_index", "f.confidence").filter(F.col("confidence") >= least)
