"""What a column's header says of its values: its concept, and by it numbers in the header's unit and dates.

A header is read on the driver, once for a column; the values are expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fuseline.functions.values import clean, let

# Fixed values: (concept, what a header has; the first line that fits), in lower case without blanks,
# brackets, - _ and /.
CONCEPTS = (
    ("metric_pm2_5", r"pm2\.?5"),
    ("metric_pm10", r"pm10"),
    ("metric_aqi", r"空气质量指数|^aqi$"),
    ("metric_pollutant", r"首要污染物"),
    ("metric_pollution_type", r"污染类型"),
    ("metric_budget_revenue", r"一般公共预算收入"),
    ("metric_budget_expenditure", r"一般公共预算支出"),
    ("metric_gdp_per_capita", r"(?=.*人均).*gdp"),
    ("metric_gdp_total", r"gdp|生产总值"),
    ("metric_population", r"人口"),
    ("metric_cases", r"病例|确诊"),
    ("metric_tests", r"检测"),
    ("date", r"日期|时间"),
    ("metric_continent", r"大洲|^洲$"),
    ("entity_region", r"国家|地区"),
    ("entity_province", r"省|自治区"),
    ("entity_city", r"城市|city"),
    ("entity_district", r"区县|^区$"),
    ("entity_name", r"站点|名称|单位"),
    ("generic_numeric", r"数|率|值|金额|指数|占比|规模"),
)
NUMERIC = ("generic_numeric", "metric_gdp_total", "metric_population", "metric_gdp_per_capita", "metric_budget_revenue", "metric_budget_expenditure", "metric_cases", "metric_tests", "metric_aqi", "metric_pm10", "metric_pm2_5")
UNIT = "万亿元|亿元|万元|万份|万例|万人|万|亿|元|份|例|%|％"
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
DATE = r"((?:19\d{2}|20\d{2}|2100))[-/.年](1[0-2]|0?[1-9])(?:[-/.月](3[01]|[12]\d|0?[1-9]))?(?:[日号])?(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"


def concept(header: str) -> str:
    """One of the concepts, or generic_text."""
    key = re.sub(r"[\s_/（）()\-]+", "", header).lower()
    return next((name for name, form in CONCEPTS if re.search(form, key)), "generic_text")


def unit_factors(header: str) -> dict[str, float]:
    """By what a number is multiplied for each unit behind it, so that it is in the header's unit."""
    text, kind = header.replace(" ", ""), concept(header)
    has = lambda u: u in text
    out = {}
    if has("亿元") or kind in ("metric_gdp_total", "metric_budget_revenue", "metric_budget_expenditure"):
        out["万亿元"] = 1e4
    if has("万元"):
        out["亿元"] = 1e4
    if has("万"):
        out["亿"] = 1e4
    elif kind == "metric_population" and not has("亿"):
        out["亿"] = 1e8
    counted = {"metric_population": "万人", "metric_tests": "万份", "metric_cases": "万例"}
    if has("亿") and not has("万亿"):
        out["万"] = 1e-4
    elif kind in counted and not has("万"):
        out["万"] = 1e4
    elif kind == "metric_gdp_per_capita" and (has("元") or has("人均")):
        out["万"] = 1e4
    if kind in counted and not has("万"):
        out[counted[kind]] = 1e4
    if kind == "metric_gdp_per_capita" and (has("元") or has("人均")):
        out["万元"] = 1e4
    return out


def header_number(value: Column, header: str) -> Column:
    """The first number of a text in the header's unit, with at most four decimals; a text without one as
    it is."""
    def convert(text: Column) -> Column:
        number = F.replace(F.regexp_extract(text, f"({NUMBER})", 1), F.lit(","), F.lit("")).try_cast("double")
        unit = F.regexp_extract(text, rf"{NUMBER}\s*({UNIT})?", 1)
        factor = F.lit(1.0)
        for u, f in unit_factors(header).items():
            factor = F.when(unit == u, f).otherwise(factor)
        shown = F.regexp_replace(F.format_string("%.4f", number * factor), r"\.?0+$", "")
        return F.when(number.isNull(), text).otherwise(shown)

    return let(clean(value), convert)


def header_date(value: Column) -> Column:
    """yyyy-MM-dd, with HH:mm:ss if there is a time, of the first date of a text (years 1900 to 2100, day 1
    if there is none); a text without one as it is."""
    def convert(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, DATE, k)
        two = lambda c, none: F.lpad(F.when(c == "", none).otherwise(c), 2, "0")
        day = F.concat_ws("-", part(1), two(part(2), "1"), two(part(3), "1"))
        time = F.concat_ws(":", two(part(4), "0"), two(part(5), "0"), two(part(6), "0"))
        return F.when(part(1) == "", text).when(part(4) == "", day).otherwise(F.concat_ws(" ", day, time))

    return let(clean(value), convert)


def header_value(value: Column, header: str) -> Column:
    """A value as its header asks for it."""
    kind = concept(header)
    if kind == "date":
        return header_date(value)
    return header_number(value, header) if kind in NUMERIC else clean(value)
