"""Entity values: what kind a header asks for, what kind a value is, and whether it may stand there.

The kind a header asks for is found on the driver, once for a column; a value's kind and the reason
against it are expressions, so legality of any number of records is one filter without Python."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import clean, let

# Endings and words that tell kinds of entities apart, and words that no name has.
ENDINGS = {
    "sub_national": ("省", "自治区", "特别行政区", "自治州", "地区"),
    "city": ("市", "州", "盟"),
    "district": ("区", "县", "旗", "镇", "乡", "街道"),
    "country": ("国", "共和国", "联邦", "王国", "公国", "酋长国"),
}
ORGANIZATION = ("公司", "集团", "大学", "学院", "医院", "委员会", "研究院", "银行", "中心", "协会", "实验室", "局")
SITE = ("站", "监测点", "采样点", "口岸", "园区", "港区", "枢纽")
METRIC = ("GDP", "人均", "人口", "病例", "确诊", "检测", "预算", "指数", "监测值", "新增")
NARRATIVE = ("高质量发展", "联防联控", "复工复产", "防控态势", "平稳可控", "重点场所", "重点区域", "三位一体")
PREFIXES = ("作为", "在", "以", "凭借", "围绕", "聚焦", "持续", "推进", "推动", "加强", "确保", "立足", "通过", "同时", "其中", "筑牢", "优化", "聚集", "整合", "协同", "统筹")
DATE = r"(?:19|20)\d{2}[-/.年](?:1[0-2]|0?[1-9])"
#: Kinds that a header of each kind accepts.
ACCEPTS = {
    "region": ("country", "sub_national", "city"),
    "province": ("sub_national",),
    "city": ("city",),
    "district": ("district", "city"),
    "name": ("metric_subject", "organization", "site", "country", "sub_national", "city", "district"),
}
HEADERS = (("region", ("国家", "地区", "区域", "country", "region")), ("province", ("省", "自治区", "特别行政区", "province")), ("city", ("城市", "city")), ("district", ("区县", "城区", "district")), ("name", ("站点", "名称", "单位", "机构", "name")))
NUMBERS = ("生产总值", "预算", "病例", "检测", "指数", "监测值", "收入", "支出", "金额", "占比")
HARD = ("date", "number", "sentence", "metric", "narrative")


def header_kind(header: str) -> str:
    """region, province, city, district or name for headers of entities, else ""."""
    low = header.lower()
    if any(w in header for w in NUMBERS):
        return ""
    return next((kind for kind, words in HEADERS if any(w in low for w in words)), "district" if header.strip() == "区" else "")


def _any(c: Column, words: tuple[str, ...], form: str = "{}") -> Column:
    """Whether a text has one of the words: anywhere, or as form says ("^{}", "{}$")."""
    return c.rlike(form.format(f"(?:{'|'.join(map(re.escape, words))})"))


def granularity(c: Column, kind: str) -> Column:
    """What a value is: by its date, words and ending, else what its header asks for."""
    text = clean(c)
    out = F.when(text == "", "").when(text.rlike(DATE), "time_scope").when(_any(text, SITE) | text.rlike(r"(?i)\b(?:site|station)\b"), "site").when(_any(text, ORGANIZATION), "organization")
    for name, endings in ENDINGS.items():
        out = out.when(_any(text, endings, "{}$"), name)
    default = {"province": "sub_national", "city": "city", "district": "district", "region": "country"}.get(kind, "metric_subject")
    return out.when(text.rlike("[A-Za-z]") & F.lit(kind != "name"), "country").otherwise(default)


def reason(c: Column, kind: str) -> Column:
    """Why a value can't stand under a header of this kind, null if it can."""
    text = clean(c)
    return (
        F.when(text == "", "blank")
        .when(text.rlike(DATE), "date")
        .when(text.rlike(r"^[-+]?[\d.,%]+$"), "number")
        .when(text.rlike("[，。；！？!?;]") | (F.length(text) > 40), "sentence")
        .when(_any(text, METRIC), "metric")
        .when(_any(text, NARRATIVE) | (_any(text, PREFIXES, "^{}") & (F.length(text) > 4)), "narrative")
        .when(~granularity(c, kind).isin(*ACCEPTS.get(kind, ACCEPTS["name"])), "granularity")
    )


def with_legality(records: DataFrame, headers: list[str]) -> DataFrame:
    """records with filter_reason: "" if some entity column holds a legal value or there is none,
    else the reasons of all; and hard_reject, whether one of them is more than a doubt."""
    kinds = {h: k for h in headers if (k := header_kind(h))}
    if not kinds:
        return records.withColumns({"filter_reason": F.lit(""), "hard_reject": F.lit(False)})
    reasons = F.array(*[F.coalesce(reason(F.col(f"`{h}`"), k), F.lit("")) for h, k in kinds.items()])
    out = records.withColumn("_reasons", reasons)
    bad = ~F.array_contains("_reasons", "")
    return out.withColumns({
        "filter_reason": F.when(bad, F.concat_ws(",", F.array_distinct("_reasons"))).otherwise(""),
        "hard_reject": bad & F.arrays_overlap("_reasons", F.array(*[F.lit(r) for r in HARD])),
    }).drop("_reasons")


# Words of a header's surroundings that ask for countries, or for parts of one; names of
# landscapes, the endings that make them names of places, and what is no place; the reasons' wording.
WORLD = ("全球", "世界", "国际", "各国", "world", "global", "international", "continent", "洲")
DOMESTIC = ("省", "市", "自治区", "特别行政区", "直辖", "地方", "行政区", "区县", "城市", "地区", "辖区")
LANDSCAPES = ("华北", "华南", "华东", "华西", "华中", "西南", "东北", "西北", "东南", "长三角", "珠三角", "京津冀", "高原", "盆地", "平原")
PLACE_ENDINGS = ("省", "市", "区", "县", "旗", "镇", "乡", "街道")
NO_PLACE = ("消杀", "边境", "境外", "口岸", "防线", "经济带", "地区联防", "防控机制", "立足", "枢纽")
REASONS = {
    "too_short": "长度过短", "too_long": "长度过长", "contains_sentence_punctuation": "包含句子级标点", "looks_numeric_or_date": "看起来像数字或日期",
    "starts_with_narrative_prefix": "以叙事前缀开头", "contains_narrative_phrase": "包含叙事短语", "contains_metric_term": "包含指标术语", "contains_predicate_particle": "包含叙事谓词结构",
    "contains_illegal_chars": "包含非法字符", "invalid_province_shape": "不符合省级实体形态", "province_like_in_city_field": "城市字段出现省级实体", "invalid_city_shape": "不符合城市实体形态",
    "invalid_district_shape": "不符合区县实体形态", "invalid_region_shape": "不符合地区实体形态", "entity_type_mismatch": "实体类型与模板语义不匹配", "granularity_mismatch": "实体粒度与模板要求不匹配",
    "region_field_country_only": "模板语义更偏向国家级实体", "compatible_admin_granularity": "模板字段允许兼容行政层级实体", "city_in_province_field": "省级字段出现城市级实体", "district_in_city_field": "城市字段出现区县级实体",
    "geographic_descriptor_not_entity": "地理描述词不是可写实体", "non_entity_phrase": "叙事短语不是可写实体",
}
GEO = ("country", "sub_national", "city", "district")
#: How well a kind of value fits a field's kind, and what speaks softly against those that don't fit.
FITS = {"region": {"country": 0.98, "sub_national": 0.88, "city": 0.78}, "province": {"sub_national": 0.96}, "city": {"city": 0.96}, "district": {"district": 0.96, "city": 0.82}}
SOFT = {
    ("province", "city"): ("city_in_province_field", 0.46),
    ("city", "district"): ("district_in_city_field", 0.52),
    ("city", "sub_national"): ("province_like_in_city_field", 0.38),
    ("district", "sub_national"): ("granularity_mismatch", 0.31),
}


@dataclass(frozen=True)
class FieldKind:
    """What a template's field asks for: its kind, the role of its values, whether countries alone will do,
    and whether its surroundings speak of parts of a country."""

    kind: str
    role: str = ""
    country_only: bool = False
    domestic: bool = False


def field_kind(header: str, peers: Sequence[str] = (), context: str = "") -> FieldKind:
    kind = header_kind(header)
    around = " ".join([header, *peers, context]).lower()
    if kind in FITS:
        world = any("大洲" in p or p.strip() == "洲" for p in peers) or any(w in around for w in WORLD)
        return FieldKind(kind, "geo_entity", kind == "region" and "地区" not in header and world, any(w in around for w in DOMESTIC))
    if kind != "name":
        return FieldKind(kind)
    site = any(w in header.lower() for w in (*SITE, "site", "station"))
    return FieldKind(kind, "station/site" if site else "organization" if any(w in header for w in ORGANIZATION) else "metric_subject")


def _hard_rules(text: Column, role: str) -> list[tuple[str, Column]]:
    """What a value of a role can't be, in the order in which it is told."""
    geo = role == "geo_entity"
    letters = r"^[A-Za-z一-龥·\s（）().'&-]{2,40}$" if geo else r"^[A-Za-z0-9#一-龥·\s（）().'&-]{2,40}$"
    rules = [
        ("too_short", F.length(text) < 2),
        ("too_long", F.length(text) > (40 if geo or role == "metric_subject" else 50)),
        ("contains_sentence_punctuation", text.rlike("[\n\r\t，,。；;！？!：:]")),
        ("looks_numeric_or_date", text.rlike(DATE) | text.rlike(r"^[-+]?\d[\d,]*(?:\.\d+)?[%％万亿元例份]*$")),
        ("starts_with_narrative_prefix", _any(text, PREFIXES, "^{}")),
        ("contains_narrative_phrase", _any(text, NARRATIVE)),
    ]
    if role != "metric_subject":
        rules += [("contains_metric_term", _any(text, METRIC)), ("contains_predicate_particle", text.contains("的"))]
    rules.append(("contains_illegal_chars", ~text.rlike(letters)))
    if geo:
        bare = text.isin(*LANDSCAPES) | (_any(text, LANDSCAPES, "^{}") & ~_any(text, PLACE_ENDINGS, "{}$"))
        rules += [("geographic_descriptor_not_entity", bare), ("non_entity_phrase", _any(text, NO_PLACE))]
    return rules


def verdict(c: Column, asked: FieldKind) -> Column:
    """struct(granularity, level, reason, score): level is accepted, soft_filter or hard_filter; an accepted value of
    a coarse field may have a reason too, which is a remark. Blank values and fields of no role are accepted."""

    def kind_of(text: Column) -> Column:
        grain = granularity(text, asked.kind)
        if asked.kind == "region" and asked.domestic and not asked.country_only:
            plain_end = ~_any(text, tuple(e for ends in ENDINGS.values() for e in ends), "{}$")
            special = text.rlike(DATE) | _any(text, SITE) | _any(text, ORGANIZATION) | text.rlike("[A-Za-z]")
            grain = F.when(plain_end & ~special, "sub_national").otherwise(grain)
        return grain

    def judge(text: Column, grain: Column) -> Column:
        say = lambda level, reason, score: F.struct(grain.alias("granularity"), F.lit(level).alias("level"), F.lit(reason).alias("reason"), F.lit(score).cast("double").alias("score"))
        out = F.when(text == "", say("accepted", "", 1.0))
        for code, holds in _hard_rules(text, asked.role):
            out = out.when(holds, say("hard_filter", code, 0.0))
        if asked.role == "organization":
            return out.when(grain == "organization", say("accepted", "", 0.95)).otherwise(say("soft_filter", "entity_type_mismatch", 0.25))
        if asked.role == "station/site":
            return out.when(grain == "site", say("accepted", "", 0.95)).otherwise(say("accepted", "", 0.88))
        if asked.role == "metric_subject":
            return out.when(grain.isin(*GEO), say("accepted", "", 0.82)).otherwise(say("accepted", "", 0.76))
        out = out.when(~grain.isin(*GEO), say("hard_filter", "entity_type_mismatch", 0.0))
        fits = {"country": 0.98} if asked.country_only else FITS[asked.kind]
        for g, score in fits.items():
            out = out.when(grain == g, say("accepted", "compatible_admin_granularity" if asked.kind == "region" and g != "country" else "", score))
        if asked.country_only:
            return out.when(grain == "sub_national", say("soft_filter", "region_field_country_only", 0.42)).otherwise(say("soft_filter", "region_field_country_only", 0.34))
        for (kind, g), (code, score) in SOFT.items():
            if kind == asked.kind:
                out = out.when(grain == g, say("soft_filter", code, score))
        return out.otherwise(say("soft_filter", "granularity_mismatch", 0.2))

    if not asked.role:
        return F.struct(F.lit("").alias("granularity"), F.lit("accepted").alias("level"), F.lit("").alias("reason"), F.lit(1.0).alias("score"))
    return let(clean(c), lambda text: let(kind_of(text), lambda grain: judge(text, grain)))


def reason_text(reason: Column) -> Column:
    """A reason in words."""
    words = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, reason), F.when(reason != "", reason), F.lit("未知原因"))


def legal(records: DataFrame, headers: list[str]) -> DataFrame:
    return with_legality(records, headers).filter("filter_reason = ''").drop("filter_reason", "hard_reject")


def writeback(records: DataFrame, headers: list[str]) -> DataFrame:
    """records with illegal entity values made blank, less those that have no entity left."""
    kinds = {h: k for h in headers if (k := header_kind(h))}
    out = records.withColumns({h: F.when(reason(F.col(f"`{h}`"), k).isNull(), F.col(f"`{h}`")) for h, k in kinds.items()})
    return out.filter(F.coalesce(*[F.col(f"`{h}`") for h in kinds]).isNotNull()) if kinds else out


def reject_counts(records: DataFrame, headers: list[str], source: str = "source_file") -> DataFrame:
    """How many records of each source each reason drops."""
    return with_legality(records, headers).filter("filter_reason <> ''").groupBy(source, "filter_reason", "hard_reject").agg(F.count("*").alias("n_dropped"))
