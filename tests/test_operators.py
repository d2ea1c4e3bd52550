"""Operators on small fixtures: quality, fusion, filters, mapping, records, audit, templates, text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fuseline.operators import audit, entities, extraction, filters, fusion, mapping, narrative, quality, records, reporting, templates
from fuseline.plans import requirement
from fuseline.sources.cells import cells_of


def test_quality_issues(spark):
    rows = [(1, "A", "12.5元", "2026年4月24日"), (2, "A", "", "bad-date"), (3, "B", "-3", "2026-01-01"), (4, "B", "-3", "2026-01-01")]
    df = spark.createDataFrame(rows, "r int, name string, price string, date string")
    cells = cells_of(df, "s", F.col("r"), ["name", "price", "date"])
    types = quality.header_types({h: [] for h in ("name", "price", "date")})
    got = {(r["issue_type"], r["issues"]) for r in quality.summary(quality.analyze(cells, types)).collect()}
    assert got == {("missing_value", 1), ("date_format_error", 1), ("range_anomaly", 2), ("duplicate_record", 1)}


def test_duplicates_keep_sign_and_point(spark):
    same = [("1,234.5元", "1234.5 元"), ("A-1", "a1"), ("2026-01-01", "2026/01/01"), ("２.５", "2.5"), ("v. 1", "v1"), ("-7", "-7")]
    other = [("12.5", "125"), ("-3", "3"), ("１．５", "15"), ("-$4", "$4"), ("0.61%", "6.1%")]
    rows = [(i, f"n{i // 2}", v) for i, v in enumerate(v for pair in same + other for v in pair)]
    cells = cells_of(spark.createDataFrame(rows, "r int, name string, v string"), "s", F.col("r"), ["name", "v"])
    assert sorted(r["raw_value"] for r in quality.duplicate_records(cells.withColumn("typed", F.struct(F.lit("").alias("standard_value")))).collect()) == ["n0|1234.5元", "n1|a1", "n2|20260101", "n3|2.5", "n4|v1", "n5|-7"]


@pytest.mark.parametrize("name", ["quality_summary", "quality_issue_counts"])
def test_quality_counts_are_their_sql(spark, tmp_path, name):
    """Customers without a name whose balances differ in sign or point alone, and two that are equal."""
    import duckdb

    from fuseline.plans import catalogue

    odd = {1: 12.34, 98: 123.4, 195: -12.34, 292: 1234.0, 389: 7.5, 486: 7.5}
    rows = [(k, f"Customer#{k:09d}", odd.get(k, 100.0 + k), "BUILDING") for k in range(500)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_outliers_need_five_values(spark):
    cells = cells_of(spark.createDataFrame([(i, "x", 1.0 if i else 100.0) for i in range(20)], "r int, name string, value double"), "s", F.col("r"), ["name", "value"])
    full = quality.with_types(cells, {"name": "entity", "value": "number"})
    assert [r["raw_value"] for r in quality.numeric_anomalies(full).collect()] == ["100"]
    assert quality.numeric_anomalies(full.filter("row_id < 4")).count() == 0


def test_filled_issues(spark):
    rows = [("a", "1", "s", "p1", 0.9, 1), ("a", "2", None, "p2", 0.3, 0), ("a", "N/A", None, "p3", None, 0)]
    filled = spark.createDataFrame(rows, "field_name string, value string, source_file string, location string, confidence double, n_evidence int")
    assert sorted(r["issue_type"] for r in quality.analyze_filled(filled).collect()) == ["low_confidence", "missing_filled_value", "value_without_evidence"]


def test_fusion_is_an_ordered_fold(spark):
    rows = [("k", "f", "1", "a", 1, 0.8, 0), ("k", "f", "2", "b", 1, 0.8, 1), ("k", "f", "3", "c", 1, 0.9, 2), ("k", "f", "3", "d", 0, 0.99, 3)]
    claims = spark.createDataFrame(rows, "entity_key string, field string, value string, source string, priority int, confidence double, seq long")
    best = fusion.fuse(claims).first()
    assert (best["value"], best["winner"], best["n_claims"]) == ("3", "c", 4)
    assert [(r["left_value"], r["right_value"]) for r in fusion.conflicts(claims).orderBy("source").collect()] == [("1", "2"), ("1", "3")]


def test_claims_of_cells(spark):
    df = spark.createDataFrame([(1, "南京", 5.0), (2, "", 6.0)], "r int, `城市` string, gdp double")
    cells = quality.with_types(cells_of(df, "s", F.col("r"), ["城市", "gdp"]), {"城市": "entity", "gdp": "number"})
    got = {(r["entity_key"], r["field"], r["value"]) for r in fusion.claims_of(cells, ["城市"]).collect()}
    assert got == {("南京", "entity_name", "南京"), ("南京", "gdp", "5"), ("s#0#2", "gdp", "6")}


def test_filters(spark):
    df = spark.createDataFrame([("2020/7/1", "北京"), ("2020-08-31 00:00:00", ""), ("2020-08-31 10:00:00", "上海市"), ("x", "广州")], "d string, c string")
    flags = [r[0] for r in df.select(filters.in_dates(F.col("d"), "2020-07-01", "2020-08-31")).collect()]
    assert flags == [True, True, False, False]
    assert [r[0] for r in df.select(filters.entity_match(F.col("c"), ["上海"])).collect()] == [False, True, True, False]
    assert filters.soft(df, F.col("c") == "none").count() == 4
    t = spark.createDataFrame([("2025-11-25 09:00:00.0",), ("2025/11/25 09:00:00",), ("",)], "d string")
    assert [r[0] for r in t.select(filters.value_match(F.col("d"), "2025-11-25 09:00:00")).collect()] == [True, True, False]


def test_requirement():
    assert requirement.parse("日期 2020/7/1 到 2020/8/31").dates == ("2020-07-01", "2020-08-31")
    assert requirement.parse("2024年2月的数据").dates == ("2024-02-01", "2024-02-29")
    r = requirement.parse("监测时间为2025-11-25 09:00:00.0\n城市：潍坊，临沂\n前5，按GDP升序")
    assert r.filters == {"监测时间": ["2025-11-25 09:00:00.0"]} and r.entities == ("潍坊", "临沂")
    assert (r.top_n, r.sort_by, r.descending, r.dates) == (5, "GDP", False, None)


def test_mapping():
    got = mapping.match_headers(["城市", "GDP（亿元）", "xyz"], ["城市名", "GDP总量（亿元）", "人口"])
    assert [(w, f) for w, f, _ in got] == [("城市", "城市名"), ("GDP（亿元）", "GDP总量（亿元）")]
    assert mapping.field_score("售价", "price") == 0.94 and mapping.field_score("a", "") == 0.0
    assert mapping.usable(["城市", "b"], [("城市", "x", 1.0), ("b", "y", 1.0)]) and not mapping.usable(["城市", "b"], [("b", "y", 1.0)])


def test_dedup_keeps_table_rows(spark):
    rows = [(0, "A", 14, "s", ["e1"], 0.5), (1, "A", 15, "s", ["e2"], 0.6), (2, "N", None, "s", ["e3"], 0.5), (3, "N", None, "s", ["e4"], 0.9)]
    df = spark.createDataFrame(rows, "seq long, v string, row_index int, source_file string, evidence array<string>, confidence double")
    got = records.dedup_records(df, ["v"], "seq", ["row_index"]).orderBy("seq").collect()
    assert [(r["v"], r["evidence"], r["confidence"]) for r in got] == [("A", ["e1"], 0.5), ("A", ["e2"], 0.6), ("N", ["e3", "e4"], 0.9)]


def test_semantic_merge(spark):
    rows = [(0, "南京", "10", 0.9, None, 0.0, "a"), (1, "南京市", "11", 0.89, "7", 0.8, "b"), (2, "北京", "1", 0.9, None, 0.0, "a"), (3, "", "5", 0.9, None, 0.0, "a")]
    df = spark.createDataFrame(rows, "seq long, city string, gdp string, gdp_conf double, pop string, pop_conf double, source_file string")
    got = {r["city"]: r for r in records.semantic_merge(df, "city", ["gdp", "pop"], "seq").collect()}
    assert (got["南京"]["gdp"], got["南京"]["pop"], got["南京"]["needs_review"], got["南京"]["n_merged"]) == ("10", "7", ["gdp"], 2)
    assert got["北京"]["needs_review"] == [] and len(got) == 3


def test_confidence(spark):
    df = spark.createDataFrame([("exact", "北京市"), ("containment", "x"), ("none", "5")], "m string, v string")
    got = [r[0] for r in df.select(records.table_confidence(F.col("m"), F.lit(1.0), F.col("v"))).collect()]
    assert 0.90 <= got[0] <= 0.98 and 0.58 <= got[1] <= 0.89 and 0.58 <= got[2] <= 0.69


def test_gold(spark):
    gold = spark.createDataFrame([(1, "18500", "a b"), (2, "", "x")], "n int, gdp string, t string")
    out = spark.createDataFrame([(1, "18500.0", "a  b"), (2, "7", "y")], "n int, gdp string, t string")
    got = audit.accuracy(audit.compare(out, gold, ["n"], ["gdp", "t"]), ["n"]).first()
    assert (got["matched_cells"], got["total_cells"], got["matched_rows"], got["meets_threshold"]) == (2, 3, 1, False)


def test_validation(spark):
    filled = spark.createDataFrame([(1, "a", "x", "s", 1, 0.9), (1, "b", None, None, 0, None)], "row_id int, field string, value string, source_file string, n_evidence int, confidence double")
    sources = spark.createDataFrame([("s", 1, 1, 2)], "source_file string, extracted_rows int, filled_rows int, contributed int")
    checks = audit.validation_checks(filled, sources, 10)
    failed = {r["check_name"] for r in checks.filter("not passed").collect()}
    assert failed == {"fill_rate", "record_coverage", "list_like_record_count", "source_stat_consistency"}
    assert audit.status(checks).first()["passed"] is False


def test_templates(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 5), (2, "B", 6)], "n int, city string, gdp int")
    md = templates.inspect("# {{city}}\n\n| city | gdp |\n| - | - |\n| | |\nend", "markdown")
    assert md.headers == ["city", "gdp"] and md.placeholders == ["city"]
    assert templates.fill_markdown(md, df, "n").splitlines()[2:7] == ["| city | gdp |", "| --- | --- |", "| A | 5 |", "| B | 6 |", "end"]
    assert templates.fill_placeholders(md, df, "n").startswith("# A；B")
    assert templates.inspect("x,y\n", "csv").headers == ["x", "y"]
    cells = templates.fill_cells(df, ["city", "area"], "n", slots=1)
    assert templates.fill_rate(cells).first()["fill_rate"] == 50.0
    templates.write_csv(df, ["city"], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["city"]


def test_narrative(spark):
    docs = spark.createDataFrame([(1, "北京市今年生产总值为100亿元。\n人口稳定增长，共有2000万人。\n上海市生产总值为90亿元。"), (2, "")], "doc_id int, text string")
    b = narrative.blocks(docs)
    groups = narrative.entity_blocks(b, F.regexp_extract("content", "([一-龥]{2}市)", 1)).orderBy("group_no").collect()
    assert [(g["first_block"], g["n_blocks"]) for g in groups] == [(0, 2), (2, 1)]
    points = narrative.summarize(docs).orderBy("doc_id").collect()
    assert len(points[0]["key_points"]) == 3 and points[1]["summary"] == ""
    kept = [r["block_index"] for r in b.filter(narrative.relevant(F.col("content"), ["生产总值"], least=10)).orderBy("block_index").collect()]
    assert kept == [0, 2]
    assert narrative.labelled_values(spark.createDataFrame([(1, "价格： 12\nx")], "doc_id int, text string"), ["价格", "日期"]).first()["value"] == "12"


def test_entities(spark):
    assert [entities.header_kind(h) for h in ("城市", "国家/地区", "省份", "区", "站点名称", "GDP", "城市生产总值")] == ["city", "region", "province", "district", "name", "", ""]
    df = spark.createDataFrame([("济南市", 1), ("新增病例", 2), ("2024年1月", 3)], "`城市` string, v int")
    assert [r["v"] for r in entities.legal(df, ["城市", "v"]).collect()] == [1]
    assert entities.writeback(df, ["城市"]).count() == 1 and entities.legal(df, ["v"]).count() == 3
    kinds = spark.createDataFrame([("X大学",), ("城东站",), ("法国",), ("张家界",)], "v string").select(entities.granularity(F.col("v"), "region"))
    assert [r[0] for r in kinds.collect()] == ["organization", "site", "country", "country"]


def test_extraction(spark):
    df = spark.createDataFrame([("GDP 达到 1,200.5 亿元",), ("100万人的总人口",), ("none",)], "v string")
    assert [r[0] for r in df.select(extraction.concept_value(F.col("v"), "gdp")).collect()] == ["1,200.5 亿元", "", ""]
    assert [r[0] for r in df.select(extraction.concept_value(F.col("v"), "population")).collect()] == ["", "100万人", ""]
    assert 0.80 <= df.select(extraction.text_confidence(F.lit("text_context"), F.col("v"))).first()[0] <= 0.89


def test_text_records_read_each_text_once(spark):
    """Values are worked out once, from what lies near digits, and are those of the whole text."""
    import random

    rng = random.Random(4)
    names = [n for group in extraction.CONCEPTS.values() for n in group] + ["ＧＤＰ", "POPULATION", "GD", "P", "人", "口"]
    pick = lambda: rng.choice([rng.choice(names), rng.choice(["12", "1,200.5 万亿元", "-3.5%", "３５０万", "7.8.9"]), "字" * rng.choice([2, 9, 31, 150]), "word " * rng.choice([1, 5, 40]), rng.choice(["\n", "   ", "\t\n", "\u3000 ", "。", "𠀀" * 70])])
    texts = ["".join(pick() for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [f"GDP{'x' * n}5{'y' * n}人口" for n in (31, 32, 33, 45, 500)] + [f"{' ' * 900}GDP{' ' * 900}8", f"9{'z' * 58}GD{'z' * 300}P{'z' * 58}9", "nan", None]
    segments = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string").withColumn("block_index", F.lit(0)).repartition(4).localCheckpoint()
    found = extraction.text_records(segments)
    got = {r["doc_id"]: r["values"] for r in found.collect()}
    want = segments.select("doc_id", *[extraction.concept_value(F.col("content"), c).alias(c) for c in extraction.CONCEPTS]).collect()
    want = {r["doc_id"]: v for r in want if (v := {c: r[c] for c in extraction.CONCEPTS if r[c]})}
    assert got == want
    assert 100 < len(want) < len(texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("map_filter(") == 1


def test_source_and_task_checks(spark):
    shape = "source_file string, narrative boolean, n_blocks int, n_segments int, extracted int, filtered int, contributed int, cell_delta int, suspicious int, unexplained int, model_run boolean, n_reasons int"
    rows = [("a", True, 4, 4, 9, 1, 0, 0, 0, 0, True, 2), ("b", False, 0, 0, 5, 0, 0, 0, 0, 3, False, 1)]
    failed = {r["check_name"] for r in audit.source_checks(spark.createDataFrame(rows, shape)).filter("not passed").collect()}
    assert failed == {"unstructured_source_contribution", "narrative_source_lower_bound", "narrative_pipeline_effectiveness", "repeated_entity_narrative", "uniform_filter_reason"}
    shape = "has_output boolean, unresolved int, response_time double, rows_filled int, n_row_ids int, n_evidence int, n_records int, model_called boolean, model_calls int, ledger_errors int"
    tasks = audit.task_checks(spark.createDataFrame([(True, 0, 95.0, 3, 2, 1, 3, True, 0, 0)], shape))
    assert {r["check_name"] for r in tasks.filter("not passed").collect()} == {"response_time", "writeback_row_count", "model_usage_truthfulness"}
    assert "| response_time | failed |" in audit.report(tasks).first()["markdown"]


@pytest.mark.parametrize(
    ("template", "value", "names", "stages", "failed"),
    [
        ("/t/城市经济-模板.docx", "潍坊市", ["a/城市经济2024.xlsx"], 2, set()),
        ("covid report-模板.xlsx", "2024年3月", ["covid data.docx", "city list.docx"], 2, {"entity_legality", "source_topic_match"}),
        ("covid report.xlsx", "N/A", ["city list.docx"], 0, {"source_topic_match", "narrative_stage_audit"}),
        ("covid report.xlsx", None, ["covid data.docx", "report data.docx", "2024.md"], 1, set()),
        ("2024.xlsx", "12.5", ["city list.docx"], 1, {"entity_legality"}),
    ],
)
def test_context_checks(spark, template, value, names, stages, failed):
    filled = spark.createDataFrame([("城市", value, "rule"), ("城市", "2024-01", "placeholder_replace"), ("GDP", "3", "rule")], "field string, value string, match_method string")
    sources = spark.createDataFrame([(n, True, 3, 1, False, stages) for n in names] + [("odd.md", True, 0, 0, False, 0)], "source_file string, narrative boolean, extracted int, contributed int, model_run boolean, n_stages int")
    checks = audit.context_checks(filled, sources, template)
    assert checks.count() == 3 and {r["check_name"] for r in checks.filter("not passed").collect()} == failed
    assert audit.status(checks).first()["passed"] is not bool(failed - {"narrative_stage_audit"})


def test_placeholders_are_replaced_once(spark):
    values = {"a": "{{b}} $1", "b": "{a}", "x.y": "[z]", "": "-"}
    texts = ["{{a}}/{b}/【a】/${b}", "{{x.y}} {{xzy}} {c}", "", None, "{}{{a}", "no marks"]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", narrative.replace_placeholders(F.col("t"), values).alias("t")).orderBy("i").collect()]
    assert got == ["{{b}} $1/{a}/{{b}} $1/{a}", "[z] {{xzy}} {c}", "", None, "-{{{b}} $1", "no marks"]
    assert spark.range(1).select(narrative.replace_placeholders(F.lit("{a}"), {})).first()[0] == "{a}"


def test_topics(spark):
    rows = [(1, "a.txt", "# 北京市 GDP Report\n\nmore"), (2, "/d/城市 data.csv", ""), (3, "x.md", "y" * 90), (4, "x", None), (5, "n" * 90 + ".txt", "z" * 99)]
    got = {r["doc_id"]: r for r in narrative.topics(spark.createDataFrame(rows, "doc_id int, name string, text string"), F.col("name")).collect()}
    assert got[1]["topic"] == "# 北京市 GDP Report" and got[1]["topic_tokens"] == ["gdp", "report", "北京市"]
    assert got[2]["topic"] == "城市 data" and got[2]["topic_tokens"] == ["data", "城市"]
    assert (got[3]["title"], got[3]["topic"], got[3]["topic_tokens"]) == ("x", "x", []) and got[4]["topic"] == "x"
    assert got[5]["topic"] == "n" * 90


def test_task_report(spark):
    cells = spark.createDataFrame([("t", 1, "f", f"{i:03}", "v", "exact", 0.1) for i in range(120)] + [("u", 1, "f", "0", "N/A", "exact", None), ("u", 2, "f", "1", None, None, 0.9)], "template string, row_no int, field_name string, location string, value string, match_method string, confidence double")
    sources = spark.createDataFrame([("a", "csv"), ("a", "csv"), ("b", None)], "source_file string, file_type string")
    issues = spark.createDataFrame([("x",), ("x",)], "issue_type string")
    conflicts = spark.createDataFrame([(t, f"{i:03}", "f", "1", "2") for t in "pq" for i in range(60)] + [("r", "0", "f", "1", "2")], "template string, entity_key string, field string, left_value string, right_value string")
    checks = spark.createDataFrame([("good", True), ("bad", False), ("none", None)], "check_name string, passed boolean")
    report = reporting.task_report(cells, sources, issues, conflicts, checks)
    got = {}
    for r in report.collect():
        got.setdefault(r["section"], {})[r["item"]] = (r["text"], r["value"])
    assert {k: v for k, (_, v) in got["figures"].items()} == {"data_source_count": 2, "quality_issue_count": 2, "template_count": 2, "fill_rate": 50, "field_match_rate": 50}
    assert got["source_types"] == {"csv": (None, 2), "": (None, 1)} and got["templates"] == {"t": ("1/120", 100), "u": ("0/2", 0)}
    assert len(got["low_confidence_fields"]) == 100 and "t:099" in got["low_confidence_fields"] and set(got["validation_failures"]) == {"bad", "none"}
    assert len(got["conflict_fields"]) == 100 and sum(k.startswith("q:") for k in got["conflict_fields"]) == 50
    text = reporting.markdown(report).first()["markdown"]
    assert text.startswith("## Figures\n- data_source_count 2.0") and text.endswith("## Failed checks\n- bad\n- none")
    empty = reporting.task_report(*[x.limit(0) for x in (cells, sources, issues, conflicts, checks)]).collect()
    assert len(empty) == 5 and all(r["value"] == 0 for r in empty)


def test_dedup_unites_evidence_once(spark):
    rows = [(i, "N", None, "s", [f"e{i % 3}", "e0"], 0.5) for i in range(30)] + [(30, "M", None, "s", None, None)]
    df = spark.createDataFrame(rows, "seq long, v string, row_index int, source_file string, evidence array<string>, confidence double")
    got = [(r["v"], r["evidence"], r["n_merged"]) for r in records.dedup_records(df, ["v"], "seq", ["row_index"]).orderBy("seq").collect()]
    assert got == [("N", ["e0", "e1", "e2"], 30), ("M", [], 1)]


def test_filled_rows_are_rows(spark):
    df = spark.createDataFrame([(7, "A"), (7, "B"), (9, None)], "n int, city string")
    cells = templates.fill_cells(df, ["city"], "n")
    assert sorted(r["row_no"] for r in cells.collect()) == [1, 2, 3] and templates.fill_rate(cells).first()["rows_filled"] == 2


def test_source_stats(spark):
    sources = spark.createDataFrame([("a", "csv", True, False), ("b", "md", False, False), ("c", "md", True, True), ("d", None, None, None)], "source_file string, file_type string, matched boolean, invalid boolean")
    one = lambda names: spark.createDataFrame([(n,) for n in names], "source_file string")
    kept = spark.createDataFrame([(["a", "b", "a"],)], "sources array<string>")
    dropped = spark.createDataFrame([("c", r) for r in "xyyzzw"] + [(None, "x")], "source_file string, reason string")
    blocks = spark.createDataFrame([("b", 2), ("b", 5)], "source_file string, n int")
    cells = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["a"], ["a"]), (3, ["a"], [])], "row_id int, evidence_sources array<string>, value_sources array<string>")
    got = {r["source_file"]: r for r in reporting.source_stats(sources, one("ab"), kept, dropped, blocks, cells).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["extracted"], a["filtered"], a["n_evidence"], a["n_values"], a["contributed"], a["relevance_score"], a["warnings"]) == (1, 1, 3, 2, 2, 1.5, ["rows_over_extracted"])
    assert (b["entity_blocks"], b["relevant"], b["relevance_score"], b["warnings"]) == (5, True, 0.5, [])
    assert (c["relevant"], c["reasons"], c["warnings"]) == (False, ["y x2", "z x2", "w x1"], ["illegal_entities", "not_relevant"]) and d["warnings"] == ["not_relevant"]


def test_normalization_report(spark):
    cells = cells_of(spark.createDataFrame([(1, "北京", "12.5元"), (2, "", "x"), (3, "N/A", "-")], "r int, city string, price string"), "s", F.col("r"), ["city", "price"])
    full = quality.with_types(cells, quality.header_types({"city": [], "price": []}))
    got = {(r["section"], r["item"]): r["n"] for r in reporting.normalization_report(full).collect()}
    assert got["unit", "元"] == 1 and sum(n for (s, _), n in got.items() if s == "status") == 5 and got["status", "type_error"] == 1 and got["status", "null"] == 2
    assert [r["raw_value"] for r in reporting.normalization_examples(full, 3).collect()] == ["北京", "12.5元", "x"]
    assert reporting.normalization_report(full.limit(0)).count() == 0 and reporting.normalization_examples(full.limit(0)).count() == 0
