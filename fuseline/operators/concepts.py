"""Values of a template's columns from text: what stands next to the columns' names.

All names of all columns are one automaton, so a text is read once however many columns are asked; numbers and dates are found
once as well, and the one nearest to a name is found by bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.automaton import Automaton
from fuseline.functions.headers import NUMERIC, concept
from fuseline.operators.extraction import DATE, LEADING

# Further names under which a concept is written, the first ones first; units behind a number; names of continents;
# the last ideographs of a leading entity that a concept takes.
ALIASES = {
    "entity_city": "城市名 城市名称 城市".split(),
    "entity_region": "国家/地区 国家地区 国家 地区".split(),
    "entity_province": "省份 省 自治区 直辖市".split(),
    "entity_district": "区 区县 城区".split(),
    "entity_name": "站点名称 名称 单位名称 机构名称 企业名称".split(),
    "metric_gdp_total": ["GDP总量", "GDP 总量", "地区生产总值", "国内生产总值"],
    "metric_population": "常住人口 人口".split(),
    "metric_gdp_per_capita": ["人均GDP", "人均 GDP", "人均地区生产总值", "人均国内生产总值"],
    "metric_budget_revenue": "一般公共预算收入 公共预算收入 预算收入".split(),
    "metric_budget_expenditure": "一般公共预算支出 公共预算支出 预算支出".split(),
    "metric_cases": "病例数 病例 确诊病例 新增确诊病例 确诊数".split(),
    "metric_tests": "每日检测数 检测量 核酸检测量 单日检测量 当日检测量".split(),
    "metric_aqi": "空气质量指数 AQI".split(),
    "metric_pm10": "PM10监测值 PM10".split(),
    "metric_pm2_5": "PM2.5监测值 PM2.5 PM25".split(),
    "metric_pollutant": "首要污染物".split(),
    "metric_pollution_type": "污染类型".split(),
    "metric_continent": "大洲 洲".split(),
    "date": "日期 时间 监测时间".split(),
}
UNITS = "万亿元 亿元 万元 万份 万例 万人 万 亿 元 份 例 %".split()
CONTINENTS = "North America,South America,Asia,Europe,Africa,Oceania,Antarctica,北美洲,南美洲,大洋洲,亚洲,欧洲,非洲,南极洲".split(",")
ENDINGS = {"entity_city": "市州盟", "entity_province": "省区市", "entity_district": "区县旗市"}
NO_CASES = re.compile("无新增病例|无新增确诊|零新增确诊|零新增病例|全零报告")
REACH, NEAR = 32, 10
NUMBER = re.compile(r"(?<![A-Za-z0-9_.])[-+]?\d+(?:,\d+)*(?:\.\d+)?")
LABELLED = re.compile(r"\s*[:：=]\s*([^，。；;,\n]{1,32})")
_DATE, _LEADING = re.compile(DATE), re.compile(LEADING)


def names_of(header: str) -> list[str]:
    """A column's names: its concept's and its own, without blanks and without what is in brackets."""
    own = [header.strip(), re.sub(r"[\s_]+", "", header), re.sub(r"[（(].*?[)）]", "", header).strip()]
    return [n for n in dict.fromkeys(x.lower() for x in [*ALIASES.get(concept(header), []), *own]) if n]


class Finder:
    """values(text): (value, method) for each of the headers, or None."""

    def __init__(self, headers: Sequence[str]):
        self.headers, self.kinds = list(headers), [concept(h) for h in headers]
        self.names = [sorted(names_of(h), key=len, reverse=True) for h in headers]
        self.machine = Automaton(dict.fromkeys([n for names in self.names for n in names] + [c.lower() for c in CONTINENTS]))

    def values(self, text: str) -> list[tuple[str, str] | None]:
        low = text.lower()
        if len(low) != len(text):  # a few capitals have longer small letters; places must be those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places: dict[str, list[tuple[int, int]]] = {}
        for a, b, i in self.machine.hits(low):
            places.setdefault(self.machine.words[i], []).append((a, b))
        numbers = [m.span() for m in NUMBER.finditer(text)]
        return [self._value(kind, names, text, places, numbers) for kind, names in zip(self.kinds, self.names, strict=True)]

    def _value(self, kind: str, names: list[str], text: str, places: dict, numbers: list[tuple[int, int]]) -> tuple[str, str] | None:
        if kind in NUMERIC:
            found = self._near(names, text, places, numbers)
            return found or (("0", "text_exact") if kind == "metric_cases" and NO_CASES.search(text) else None)
        if kind == "date":
            for name in names:
                for _, end in places.get(name, ()):
                    if m := re.compile(rf"[：:\s]{{0,3}}({DATE})").match(text, end):
                        return m[1], "text_exact"
            first = _DATE.search(text)
            return (first[0], "text_exact") if first else None
        if kind == "metric_continent":
            found = sorted((a, c) for c in CONTINENTS for a, _ in places.get(c.lower(), ())[:1])
            return (found[0][1], "text_context") if found else None
        labelled = next((m[1].strip() for name in names for _, end in places.get(name, ()) if (m := LABELLED.match(text, end))), "")
        if not kind.startswith("entity"):
            return (labelled, "text_context") if labelled else None
        lead = _LEADING.match(text)
        entity = lead[1] if lead else ""
        if kind in ENDINGS and "一" <= entity[-1:] <= "龥" and entity[-1] not in ENDINGS[kind]:
            entity = ""
        order = [(labelled, "text_context"), (entity, "entity_lead")]
        return next((x for x in (order if kind == "entity_region" else reversed(order)) if x[0]), None)

    def _near(self, names: list[str], text: str, places: dict, numbers: list[tuple[int, int]]) -> tuple[str, str] | None:
        """The number nearest to the longest name that has one within reach; before it where as near as behind."""
        starts, ends = [a for a, _ in numbers], [b for _, b in numbers]
        for name in names:
            best: tuple[int, int, bool] | None = None
            for a, b in places.get(name, ()):
                before, behind = bisect_right(ends, a) - 1, bisect_left(starts, b)
                for k, apart, later in ((before, a - ends[before] if before >= 0 else REACH + 1, False), (behind, starts[behind] - b if behind < len(starts) else REACH + 1, True)):
                    inside = 0 <= k < len(numbers) and (numbers[k][0] >= a - REACH if not later else numbers[k][1] <= b + REACH)
                    if inside and (best is None or apart < best[0]):
                        best = (apart, k, later)
            if best:
                apart, k, later = best
                value, rest = text[slice(*numbers[k])], text[numbers[k][1] : numbers[k][1] + 8].lstrip()
                unit = next((u for u in UNITS if rest.startswith(u)), "")
                return f"{value} {unit}".strip() if unit != "%" else value + unit, "text_exact" if later or apart <= NEAR else "text_approx"
        return None


def header_values(content: Column, headers: Sequence[str]) -> Column:
    """Array of (header, value, method) of the headers that a text has a value for."""
    finder = Finder(headers)
    kind = pa.list_(pa.struct([("header", pa.string()), ("value", pa.string()), ("method", pa.string())]))

    @F.arrow_udf("array<struct<header: string, value: string, method: string>>")
    def found(text: pa.Array) -> pa.Array:
        out = []
        for x in text.to_pylist():
            got = finder.values(x or "")
            out.append([{"header": h, "value": v[0], "method": v[1]} for h, v in zip(finder.headers, got, strict=True) if v])
        return pa.array(out, kind)

    return found(content)


def header_records(segments: DataFrame, headers: Sequence[str], least: int = 2) -> DataFrame:
    """doc_id, block_index, values and methods (maps by header) of segments (doc_id, block_index, content) in which at least so
    many headers have a value."""
    rows = segments.select("doc_id", "block_index", header_values(F.col("content"), headers).alias("v")).filter(F.size("v") >= least)
    part = lambda c: F.map_from_arrays("v.header", f"v.{c}")
    return rows.select("doc_id", "block_index", part("value").alias("values"), part("method").alias("methods"))
