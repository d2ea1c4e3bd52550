"""A requirement's text as a Requirement: dates, values, entities and number of rows.

Requirements come as short labelled lines; a few patterns find what they say."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field

from fuseline.operators.filters import Requirement

DAY = re.compile(r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})")
MONTH = re.compile(r"(\d{4})[-/.年](\d{1,2})(?![-/.\d月]*\d)")
TOP = re.compile(r"(?:前|top\s*)(\d+)", re.I)
SORT = re.compile(r"按\s*([^\s，,；;。]+?)\s*(降序|升序)")
VALUES = re.compile(r"(?:筛选|filter)\s*[:：]\s*([^\n。]+)", re.I)
MOMENT = re.compile(r"([一-龥A-Za-z_]+)为(\d{4}[-/]\d{1,2}[-/]\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)")
ENTITIES = re.compile(r"(?:城市|地区|国家|省份|实体|entities|cities)\s*[:：]\s*([^\n。]+)", re.I)
SEPARATOR = re.compile(r"[,，、;；]\s*")


TABLE = re.compile(r"表[一二三四五六七八九十\d]+[：:]")
PAIR = re.compile(r"([^\s：:]{1,20})[：:]\s*(.+)")
INDICATORS = re.compile(r"(?:指标关键词|指标范围|关键词|提取|统计|分析|计算|汇总|填写|指标|数据项|字段|表头)[：:]\s*([^\n。]+)")
STRICT = re.compile(r"严格匹配[：:]\s*(是|否|true|false|yes|no)", re.I)
# Words that ask for rows or for a summary, and notes.
ROWS, SUMMARY = ("逐条", "逐行", "明细", "每个实体", "排行榜", "名单"), ("汇总", "总计", "总览", "摘要")
NOTES = ("严格匹配", "允许留空", "禁止猜测", "不要猜测", "精确匹配", "模糊匹配", "不要留空", "必须填写")


@dataclass(frozen=True)
class Details:
    """What a requirement says beside its filters: values for each of the template's tables by their number,
    indicators, rows or summary (None: neither), whether matching is strict (None: not said), and notes."""

    tables: dict[int, dict[str, str]] = field(default_factory=dict)
    indicators: tuple[str, ...] = ()
    granularity: str | None = None
    strict: bool | None = None
    notes: tuple[str, ...] = ()


def details(text: str) -> Details:
    bodies = TABLE.split(text)[1:]
    tables = {k: dict(m.groups() for m in map(PAIR.match, map(str.strip, body.strip().splitlines())) if m) for k, body in enumerate(bodies)}
    indicators = [i.strip() for body in INDICATORS.findall(text) for i in SEPARATOR.split(body.strip()) if 0 < len(i.strip()) <= 40]
    kinds = [kind for kind, words in (("rows", ROWS), ("summary", SUMMARY)) if any(w in text for w in words)]
    strict = STRICT.search(text)
    return Details(
        {k: {key: v.strip() for key, v in spec.items()} for k, spec in tables.items() if spec}, tuple(dict.fromkeys(indicators)), kinds[0] if kinds else None,
        strict.group(1).lower() in ("是", "true", "yes") if strict else None, tuple(n for n in NOTES if n in text),
    )


def parse(text: str) -> Requirement:
    days = [f"{int(y):04d}-{int(m):02d}-{int(d):02d}" for y, m, d in DAY.findall(MOMENT.sub("", text))]
    dates = (days[0], days[1]) if len(days) > 1 else None
    if dates is None and not days and (m := MONTH.search(MOMENT.sub("", text))):
        year, month = int(m.group(1)), min(max(int(m.group(2)), 1), 12)
        dates = (f"{year:04d}-{month:02d}-01", f"{year:04d}-{month:02d}-{calendar.monthrange(year, month)[1]:02d}")
    filters: dict[str, list[str]] = {}
    for body in VALUES.findall(text):
        for part in re.split(r"[;；]\s*", body):
            key, eq, values = part.partition("=")
            if eq:
                filters[key.strip()] = [v.strip() for v in SEPARATOR.split(values) if v.strip()]
    for key, value in MOMENT.findall(text):
        filters[key] = [value]
    entities = [e.strip() for body in ENTITIES.findall(text) for e in SEPARATOR.split(body) if e.strip()]
    top, sort = TOP.search(text), SORT.search(text)
    return Requirement(dates, filters, tuple(entities), int(top.group(1)) if top else None, sort.group(1) if sort else None, not sort or sort.group(2) == "降序")
