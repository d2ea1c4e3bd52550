"""Scalar functions and the registry against fixed cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fuseline.functions import values as V
from fuseline.functions.registry import DEFAULT, name_key


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("5775 万", 57750000.0), ("7.3 万元", 73000.0), ("12.6 万份", 126000.0), ("1,234.50", 1234.5), ("-5", -5.0), ("abc", None), ("", None), (None, None), ("三万", 3e8), ("二十三", 23.0), ("1.2万亿", 1.2e12), ("３亿", 3e8), ("十", 10.0)],
)
def test_number(spark, text, want):
    assert apply(spark, V.number, [text]) == [want]


def test_percent_and_units(spark):
    assert apply(spark, V.percent, ["12%", "百分之5", "0.3", "x"]) == [0.12, 0.05, 0.3, None]
    assert apply(spark, V.unit, ["12万元", "5 kg", "7", "30%", "平方公里"]) == ["万元", "kg", "", "%", "平方公里"]


def test_date(spark):
    cases = {"2024-01-05": "2024-01-05", "2024/1/5": "2024-01-05", "2024年3月": "2024-03-01", "2024": "2024-01-01", "2024-13-45": "2024-01-01", "2024-02-30": "2024-02-01", "20240105": "2024-01-01", "2025-11-25 09:00:00.0": "2025-11-25", "bad-date": None, "": None}
    assert apply(spark, V.date, list(cases)) == list(cases.values())


def test_clean_and_null(spark):
    assert apply(spark, V.clean, [" a ", "NaN", "None", "nat", "", None]) == ["a", "", "", "", "", ""]
    assert apply(spark, V.is_missing, ["-", "...", "（无）", "N/A", "缺失", "0", "x", None]) == [True, True, True, True, True, False, False, True]


def test_name_key_agrees_with_the_driver(spark):
    texts = ["GDP（亿元）", "  A_b-C ", "1.5", "-5", "城市 名称", "x(y)z", "Ｎａｍｅ", "a/b\\c"]
    assert apply(spark, V.name_key, texts) == [name_key(t) for t in texts]


def test_typed_status(spark):
    df = spark.createDataFrame([("12.5元",), ("",), ("abc",), ("bad-date",)], "v string")
    got = [r[0].asDict() for r in df.select(V.typed(F.col("v"), "number")).collect()]
    assert [g["status"] for g in got] == ["ok", "null", "type_error", "type_error"]
    assert got[0]["num"] == 12.5 and got[0]["unit"] == "元" and got[0]["standard_value"] == "12.5"


def test_rendered(spark):
    df = spark.createDataFrame([(12345678.0,), (0.0001,), (1.5,), (-0.0,)], "v double")
    assert [r[0] for r in df.select(V.rendered(F.col("v"))).collect()] == ["12345678", "0.0001", "1.5", "0"]


def test_nfkc_is_exact(spark):
    assert apply(spark, V.nfkc, ["ﬁ①", "Å", None]) == ["fi1", "Å", None]


def test_registry():
    assert [DEFAULT.field_type(h) for h in ("capacity", "l_discount", "售价", "预算", "增长", "统计日期")] == ["entity", "number", "number", "currency", "text", "date"]
    assert DEFAULT.field_type("x", ["2024-01", "2023/5", ""]) == "date"
    assert DEFAULT.field_type("x", ["1", "2", "a"]) == "number"
    assert DEFAULT.canonical_name("销售价格") == "price" and DEFAULT.canonical_name("City") == "entity_name"
    assert DEFAULT.key_columns(["a", "城市", "id", "name"]) == [1, 2] and DEFAULT.key_columns(["a", "b"]) == [0]
    assert DEFAULT.with_overrides(canonical={"tax": ["l_tax"]}).canonical_name("l_tax") == "tax"
