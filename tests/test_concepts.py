"""Values beside names: hand-written sentences, a plain search for the nearest number, and long texts."""

from __future__ import annotations

import random
import re
import time

import pytest

from fuseline.operators import concepts


def value(header, text):
    return concepts.Finder([header]).values(text)[0]


@pytest.mark.parametrize(
    ("header", "text", "want"),
    [
        ("GDP总量", "潍坊市实现地区生产总值约为7471.4亿元，常住人口939万人。", ("7471.4 亿元", "text_exact")),
        ("常住人口(万)", "潍坊市实现地区生产总值约为7471.4亿元，常住人口939万人。", ("939 万人", "text_exact")),
        ("人均GDP", "以 217,710 元的高位人均GDP领先", ("217,710 元", "text_exact")),
        ("一般公共预算收入", "预算收入 8,500.91亿元，预算支出 10,506.3亿元", ("8,500.91 亿元", "text_exact")),
        ("一般公共预算支出", "预算收入 8,500.91亿元，预算支出 10,506.3亿元", ("10,506.3 亿元", "text_exact")),
        ("病例数", "当日全省无新增病例", ("0", "text_exact")),
        ("每日检测数", "完成核酸检测量 12万份", ("12 万份", "text_exact")),
        ("AQI", "aqi: 57, PM10 监测值 80", ("57", "text_exact")),
        ("PM2.5", "PM2.5监测值 35，PM10监测值 80", ("35", "text_exact")),
        ("首要污染物", "首要污染物：臭氧，AQI 57", ("臭氧", "text_context")),
        ("大洲", "Japan lies in Asia, not in Europe", ("Asia", "text_context")),
        ("监测时间", "发布 2023-01-02，监测时间：2024年3月5日", ("2024年3月5日", "text_exact")),
        ("监测时间", "发布于 2023-01-02", ("2023-01-02", "text_exact")),
        ("城市", "青岛市全年增长", ("青岛市", "entity_lead")),
        ("城市", "山东省全年增长，城市：济南", ("济南", "text_context")),
        ("国家/地区", "国家：日本，人口 1 亿", ("日本", "text_context")),
        ("国家/地区", "New Zealand has 5 million", ("New Zealand", "entity_lead")),
        ("增长率", "增长率高达 5.6%", ("5.6%", "text_exact")),
        ("增长率", "没有", None),
        ("备注", "备注: ok", ("ok", "text_context")),
        ("GDP总量", "İ GDP总量 5", ("5", "text_exact")),
        ("GDP总量", "", None),
    ],
)
def test_values(header, text, want):
    assert value(header, text) == want


def plain_nearest(names, text):
    """Every number within reach of every place of a name, the nearest first."""
    for name in names:
        found = []
        for hit in re.finditer(f"(?={re.escape(name)})", text.lower()):
            a, b = hit.start(), hit.start() + len(name)
            for m in concepts.NUMBER.finditer(text):
                if a - 32 <= m.start() and m.end() <= a:
                    found.append((a - m.end(), a, 0, m[0]))
                elif b <= m.start() and m.end() <= b + 32:
                    found.append((m.start() - b, a, 1, m[0]))
        if found:
            return min(found)[3]
    return None


def test_nearest_number_against_a_plain_search():
    rng = random.Random(3)
    finder = concepts.Finder(["AQI", "常住人口"])
    for _ in range(2000):
        text = "".join(rng.choice(["aqi", "AQI ", "人口", "常住人口", " 12", "3.5 ", ", ", "abc ", "-7 ", "长" * 9]) for _ in range(rng.randint(1, 14)))
        for names, got in zip(finder.names, finder.values(text), strict=True):
            assert (got and re.match(concepts.NUMBER, got[0])[0]) == plain_nearest(names, text), text


def test_long_texts_take_linear_time():
    finder = concepts.Finder(["AQI", "PM10", "常住人口", "日期"])
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert finder.values("aqi 12 pm10 " * n)[0] == ("12", "text_exact")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_records(spark):
    rows = [(1, 0, "青岛市 AQI 57， PM10 80"), (1, 1, "only AQI 5"), (2, 0, None)]
    out = concepts.header_records(spark.createDataFrame(rows, "doc_id int, block_index int, content string"), ["城市", "AQI", "PM10"]).collect()
    assert [(r["doc_id"], r["values"]) for r in out] == [(1, {"城市": "青岛市", "AQI": "57", "PM10": "80"})]
