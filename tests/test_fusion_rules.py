"""Headers, pairing, requirement sections, lenient texts, bodies, document operations."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fuseline.functions import headers, lenient
from fuseline.functions.registry import DEFAULT, Registry, name_key
from fuseline.functions.values import clean, plain
from fuseline.functions.values import name_key as name_key_of
from fuseline.operators import documents, entities, filters, fusion, mapping, pairing, records
from fuseline.plans import requirement
from fuseline.sources import readers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("header", "kind"),
    [("PM2.5监测值", "metric_pm2_5"), ("PM10", "metric_pm10"), ("AQI", "metric_aqi"), ("首要污染物", "metric_pollutant"), ("污染类型", "metric_pollution_type"), ("一般公共预算收入（亿元）", "metric_budget_revenue"), ("一般公共预算支出", "metric_budget_expenditure"), ("人均 GDP（元）", "metric_gdp_per_capita"), ("GDP总量", "metric_gdp_total"), ("常住人口", "metric_population"), ("新增确诊", "metric_cases"), ("每日检测数", "metric_tests"), ("监测时间", "date"), ("大洲", "metric_continent"), ("国家/地区", "entity_region"), ("省份", "entity_province"), ("City", "entity_city"), ("区", "entity_district"), ("站点名称", "entity_name"), ("增速率", "generic_numeric"), ("备注", "generic_text")],
)
def test_concepts(header, kind):
    assert headers.concept(header) == kind


@pytest.mark.parametrize(
    ("header", "value", "want"),
    [("常住人口", "5775 万", "57750000"), ("人均GDP（元）", "7.3 万元", "73000"), ("每日检测数", "12.6 万份", "126000"), ("GDP（亿元）", "1.2万亿元", "12000"), ("金额（万元）", "3亿元", "30000"), ("人口（万人）", "1.5亿", "15000"), ("GDP（亿元）", "5000万", "0.5"), ("名称", " a ", "a"), ("金额", "没有", "没有"), ("金额", "1,234.50元", "1234.5"), ("日期", "2024年3月5日 9:05", "2024-03-05 09:05:00"), ("日期", "于2024/3", "2024-03-01"), ("日期", "soon", "soon")],
)
def test_values_by_header(spark, header, value, want):
    assert one(spark, headers.header_value(F.lit(value), header)) == want


def test_values_in_both_forms(spark):
    """Short ways for plain text give what the long ones do."""
    rng = random.Random(3)
    texts = [None, "", "nan", " None ", "NaT", "nano", "（无）", "  a  b ", "ａｂＣ１", "x\ty", "(a)b", "A-b_c.d", "a\u3000b", "\xa0q", "end\n", "--", "无"]
    texts += ["".join(rng.choice("aB1 -_.()（）\t\u3000é无，#") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean(F.col("t")), plain(F.col("t")), name_key_of(F.col("t"))).collect()
    for t, c, p, k in rows:
        bare = (t or "").strip()
        bare = "" if bare.lower() in ("nan", "none", "nat") else bare
        assert c == bare and k == name_key(t or "")
        assert p == " ".join("".join(chr(ord(x) - 0xFEE0) if "！" <= x <= "～" else " " if x in "\u3000\xa0" else x for x in bare.replace("。", ".")).split())


def test_registry_types_and_names():
    assert [DEFAULT.field_type(h) for h in ("城市", "o_orderdate", "单价", "growth_rate", "expense", "备注")] == ["entity", "date", "number", "percent", "currency", "text"]
    assert DEFAULT.field_type("x", ["2024-01", "2024-02", "y"]) == "date" and DEFAULT.field_type("x", ["a", "b"]) == "text" and DEFAULT.field_type("x", ["1", "z"]) == "number"
    assert DEFAULT.canonical_name("售价") == "price" and DEFAULT.canonical_name("Some Thing") == "something" and DEFAULT.canonical_name("") == ""
    other = Registry(field_types={}).with_overrides(canonical={"area": ["面积"]})
    assert other.field_type("城市") == "text" and other.canonical_name("面积") == "area"
    assert mapping.field_score("单价", "售价") == 0.94 and mapping.field_score("a", "a") == 1.0 and mapping.field_score("人口总数", "人口") == 0.84 and mapping.field_score("", "x") == 0.0
    assert mapping.match_longest_first(["b", "long name"], ["name", "b c"]) == {"b": "b c", "long name": "name"}


def test_pairs_of_tables(spark):
    """Headers of another domain are no pair; an entity column alone is enough where there is no domain."""
    t = spark.createDataFrame([("air", ["城市", "AQI", "PM2.5"]), ("economy", ["城市", "GDP（亿元）"]), ("list", ["名称", "备注"]), ("none", [" ", None])], "name string, headers array<string>")
    s = spark.createDataFrame([("covid", ["地区", "确诊", "死亡"]), ("gdp", ["城市名", "GDP总量（亿元）", "常住人口"]), ("blank", [])], "name string, headers array<string>")
    pairs = {(r["template"], r["source"]) for r in pairing.plausible_pairs(t, s).collect()}
    assert pairs == {("economy", "gdp"), ("list", "covid"), ("list", "gdp")}
    got = {(r["template"], r["source"]): r for r in pairing.table_candidates(t, s).collect()}
    best = got["economy", "gdp"]
    assert best["confidence"] == 1.0 and [m["source_header"] for m in best["mapping"]] == ["城市名", "GDP总量（亿元）"]
    assert pairing.plausible_pairs(t.filter("false"), s).count() == 0
    b = spark.createDataFrame([(1, 0, "GDP of the city"), (1, 1, "none")], "doc_id int, block_index int, content string")
    assert [tuple(r) for r in pairing.text_evidence(b, ["city GDP growth"]).collect()] == [("city GDP growth", 1, 0, 0.6667)]


def test_requirement_sections(spark):
    text = "表一：\n监测时间：2025-11-25 09:00:00.0\n城市：德州市\n表二：城市：潍坊市\n严格匹配：是\n指标：GDP、人口；请逐条输出，不要猜测"
    d = requirement.details(text)
    assert d.tables[0] == {"监测时间": "2025-11-25 09:00:00.0", "城市": "德州市"} and d.tables[1]["城市"] == "潍坊市"
    assert d.indicators[:2] == ("GDP", "人口") and d.granularity == "rows" and d.strict is True and d.notes == ("严格匹配", "不要猜测")
    assert requirement.details("汇总") == requirement.Details(granularity="summary")
    df = spark.createDataFrame([("德州市", "2025/11/25 09:00:00"), ("德州", "x"), ("青岛市", "y")], "`城市` string, `监测时间` string")
    assert filters.apply_table_spec(df, d.tables[0]).count() == 1
    assert filters.apply_table_spec(df, {"城市": "德州市"}).count() == 2 and filters.apply_table_spec(df, {"城市": "北京"}).count() == 3 and filters.apply_table_spec(df, {"zzz": "1"}).count() == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('Sure! Here it is: {"a": "b", "c": null} Bye', {"a": "b", "c": None}),
        ("{'a': 'it''s', 'b': True, 'c': None,}", None),
        ("{'name': 'don\'t', b: True, c: None,}", {"name": "don't", "b": True, "c": None}),
        ("{'say': 'it's fine', 'n': 2}", {"say": "it's fine", "n": 2}),
        ('[{"a": 1}, {"a": 2},]', [{"a": 1}, {"a": 2}]),
        ('{"a": [1, 2, {"b": "cut', {"a": [1, 2, {"b": "cut"}]}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{城市: "x", "n": 007.5}', {"城市": "x", "n": 7.5}),
        ('{"e": "\\u00e9\\n"}', {"e": "é\n"}),
    ],
)
def test_lenient_json(text, want):
    got = lenient.read_lenient(text)
    assert want is None and got["b"] is True or got == want


def test_lenient_json_of_odd_texts(spark):
    for t in (None, "", "  ", "no json", "}"):
        with pytest.raises(ValueError):
            lenient.read_lenient(t)
    deep = lenient.read_lenient("[" * 20_000)
    assert isinstance(deep, list)
    rng = random.Random(1)
    for _ in range(300):
        value = {"k": [rng.random(), {"q": "x\"y"}], "z": [None, True, "é"]}
        assert lenient.read_lenient(f"so: {json.dumps(value)} end") == value
        cut = json.dumps(value)[: rng.randint(1, 40)]
        lenient.read_lenient(cut)
    df = spark.createDataFrame([("{'a': 1}",), (None,), ("[" * 20_000,)], "t string").select(lenient.lenient_json("t").alias("j")).select("j.*").collect()
    assert [r["json"] for r in df] == ['{"a": 1}', None, None] and df[1]["error"]


def test_shortened_and_smart(spark):
    assert one(spark, lenient.shortened(F.lit("abcdef"), 3)) == "abc\n... (truncated, total 6 chars)" and one(spark, lenient.shortened(F.lit(None).cast("string"), 3)) == ""
    assert one(spark, lenient.digit_runs(F.lit("a 1,234.5 b -7"))) == ["1234.5", "-7"]
    got = [tuple(one(spark, lenient.smart_value(F.lit(v)))) for v in ("1,200", "-3.50", "x1", "1e5", "")]
    assert got == [(1200, None, None), (None, -3.5, None), (None, None, "x1"), (None, None, "1e5"), (None, None, "")]


def test_bodies_and_page_blocks(spark):
    rows = [("u1", "text/csv", "A;B\n1;\"x\ny\"\n"), ("u2", "application/json", '[{"a": 1, "b": {"c": 2}}, {"a": 3}]'), ("u3", None, '{"items": [{"k": "v"}]}'), ("u4", "text/plain", ""), ("u5", "text/html", "<p>x</p>")]
    got = {tuple(r) for r in readers.body_cells(spark.createDataFrame(rows, "url string, content_type string, body string")).collect()}
    assert got == {("u1", 0, "A", "1"), ("u1", 0, "B", "x\ny"), ("u2", 0, "a", "1"), ("u2", 0, "b", '{"c":2}'), ("u2", 1, "a", "3"), ("u3", 0, "k", "v")}
    html = "<html><head><title>T</title></head><body><h1>Head</h1><p>One <b>two</b><p>three<ul><li>x<li>y</ul><table><tr><td>cell</table><script>z</script>end"
    assert readers.html_blocks(html) == [("Head", 1), ("One two", 0), ("three", 0), ("x", 0), ("y", 0), ("end", 0)]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert readers.page_blocks(pages).count() == 6
    assert readers.body_blocks(spark.createDataFrame([("u", "t", "a\n\nb")], "url string, content_type string, body string")).count() == 2


def test_document_operations(spark):
    assert documents.asked_fields("提取：价格、日期；数量") == ["价格", "日期", "数量"] and documents.asked_fields("") == []
    docs = spark.createDataFrame([(1, "价格：12元，日期: 2024-01-05\n价格：13"), (2, None)], "doc_id int, text string")
    assert sorted((r["field"], r["value"]) for r in documents.labelled(docs, ["价格", "日期"]).collect()) == [("价格", "12元"), ("价格", "13"), ("日期", "2024-01-05")]
    assert [one(spark, documents.intent(F.lit(t))) for t in ("请总结", "找 find it", "")] == ["summarize", "find", "inspect"] and one(spark, documents.intent(F.lit("总结"), F.lit(" Export "))) == "export"
    b = spark.createDataFrame([(1, 0, " ａ  b "), (1, 1, " ")], "doc_id int, block_index int, content string")
    assert [r["line"] for r in documents.formatted_lines(b).collect()] == ["a b"]


def test_records_that_may_merge(spark):
    rows = [(("x", "", "", False), ("x", "1", "2024-01", False), True), (("x", "1", "2024-01", False), ("y", "2", "2024-01", False), False), (("x", "1", "2024-02", False), ("x", "", "2024年1月", False), False), (("x", "", "", True), ("x", "1", "", False), False), (("", "", "", False), ("", "", "", False), False)]
    df = spark.createDataFrame(rows, "a struct<p string, q string, w string, t boolean>, b struct<p string, q string, w string, t boolean>, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", records.complementary("a", "b", ["p", "q"], "t", "w")).collect())


@pytest.mark.parametrize(
    ("header", "peers", "value", "level", "reason"),
    [
        ("国家", ["大洲"], "山东省", "soft_filter", "region_field_country_only"), ("国家", ["大洲"], "泰国", "accepted", ""), ("国家/地区", [], "山东省", "accepted", "compatible_admin_granularity"),
        ("地区", ["城市"], "山东", "accepted", "compatible_admin_granularity"), ("省份", [], "青岛市", "soft_filter", "city_in_province_field"), ("区县", [], "山东省", "soft_filter", "granularity_mismatch"),
        ("区", [], "寿光市", "accepted", ""), ("站点名称", [], "市政府", "accepted", ""), ("机构名称", [], "某某公司", "accepted", ""), ("名称", [], "人均值", "accepted", ""), ("GDP", [], "任何，东西", "accepted", ""),
        ("城市", [], "x" * 41, "hard_filter", "too_long"), ("城市", [], "高质量发展市", "hard_filter", "contains_narrative_phrase"),
    ],
)
def test_entity_verdicts(spark, header, peers, value, level, reason):
    got = one(spark, entities.verdict(F.lit(value), entities.field_kind(header, peers)))
    assert (got["level"], got["reason"]) == (level, reason)
    assert one(spark, entities.reason_text(F.lit(reason))) == (entities.REASONS.get(reason) or "未知原因")


def test_conflicts_in_stretches(spark):
    """Stretches of any length give what one pass over each key gives; a hot key's too."""
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.choice("xy"), rng.choice(["1", "2", "3", " 2"]), "s", rng.randint(1, 3), rng.choice([0.5, 0.9]), i) for i in range(600)]
    want, held = [], {}
    for key, field, value, _, priority, confidence, seq in rows:
        mine, best = (priority, confidence, -seq, value), held.get((key, field))
        if best and best[3].strip() != value.strip():
            want.append((key, field, best[3], value))
        held[key, field] = max(mine, best) if best else mine
    df = spark.createDataFrame(rows, "entity_key string, field string, value string, source string, priority int, confidence double, seq long")
    for stretch in (1, 7, 100, 100_000):
        assert sorted(tuple(r)[:4] for r in fusion.conflicts(df, stretch).collect()) == sorted(want)


def test_contested_values_of_a_hot_entity(spark):
    rows = spark.range(30_000).selectExpr("'city' AS name", "cast(id % 5000 AS string) AS v", "double(id % 100) / 100 AS v_conf", "id AS seq", "'s' AS source_file", "'same' AS w", "0.5D AS w_conf")
    one = records.semantic_merge(rows, "name", ["v", "w"], "seq").first()
    assert one["v"] == "99" and one["v_conf"] == 0.99 and one["needs_review"] == ["v"] and one["n_merged"] == 30_000
    clear = rows.withColumn("v_conf", F.when(F.col("seq") == 3, 1.0).otherwise(0.9))
    assert records.semantic_merge(clear, "name", ["v", "w"], "seq").first()["needs_review"] == []
