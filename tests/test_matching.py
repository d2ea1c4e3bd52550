"""Comparison by position, template contexts and evidence on small hand-written tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fuseline.functions.automaton import Automaton, words_in
from fuseline.operators import context, lookup, merging, narrative, pairing, position, regions


def test_numbers_in_order(spark):
    keys = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(k, None if k % 50 == 0 else k) for k in keys], "k int, v int").repartition(7)
    out = position.numbered(df, ["k"])
    assert [tuple(r) for r in out.orderBy("row_no").select("k", "row_no").collect()] == [(k, i + 1) for i, k in enumerate(sorted(keys))]
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert position.numbered(df.filter("false"), ["k"]).count() == 0
    ties = position.numbered(spark.createDataFrame([(1, "a")] * 50 + [(None, "b")], "k int, v string"), ["k"])
    assert sorted(r["row_no"] for r in ties.collect()) == list(range(1, 52)) and ties.filter("v = 'b'").first()["row_no"] == 1


def test_positions(spark):
    gold = spark.createDataFrame([(1, "a", "1.0"), (2, "b", None), (3, "c", "3"), (4, None, "4")], "row_no long, x string, y string")
    out = spark.createDataFrame([(1, " a ", "1", "n"), (2, "B", "9", None)], "row_no long, x string, y string, z string")
    cells = {(r["row_no"], r["column_name"]): r["status"] for r in position.compare_positions(out, gold).collect()}
    assert cells == {(1, "x"): "equal", (1, "y"): "equal", (2, "x"): "different", (3, "x"): "missing", (3, "y"): "missing", (4, "y"): "missing"}
    all_cells = position.compare_positions(out, gold, ignore_empty=False)
    assert all_cells.filter("row_no = 2 AND column_name = 'y' AND status = 'different'").count() == 1
    one = position.positional_accuracy(out, gold).first()
    assert (one["output_row_count"], one["gold_row_count"], one["compared_rows"], one["total_cells"], one["matched_cells"], one["matched_rows"]) == (2, 4, 2, 3, 2, 1)
    assert (one["missing_cells"], one["extra_cells"], float(one["cell_accuracy"]), float(one["row_accuracy"]), one["meets_threshold"]) == (3, 0, 66.67, 50.0, False)
    back = position.positional_accuracy(gold, out).first()
    assert back["extra_cells"] == 3 and back["missing_cells"] == 0
    none = position.positional_accuracy(out.filter("false"), gold.filter("false")).first()
    assert none["total_cells"] == 0 and none["compared_rows"] == 0
    same = position.positional_accuracy(gold, gold).first()
    assert same["matched_rows"] == 4 and same["meets_threshold"]
    assert position.compare_positions(gold.withColumn("a.b", F.lit(1)), gold).filter("column_name = 'a.b'").count() == 0


def test_automaton_finds_every_place(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    machine = Automaton(words)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(60))
        want = sorted((i, i + len(w), k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i))
        assert sorted(machine.hits(text)) == want
        spans = [(a, b) for a, b, _ in want]
        outer = sorted({s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)})
        assert [(a, b) for a, b, _ in machine.longest(text)] == outer
    df = spark.createDataFrame([("xaby",), (None,), ("",), ("b a",)], "c string")
    assert [r[0] for r in df.select(words_in(F.col("c"), ["b", "a", "zz", "b", ""])).collect()] == [["b", "a"], [], [], ["b", "a"]]
    assert [r[0] for r in df.select(words_in(F.col("c"), [])).collect()] == [[], [], [], []]


def test_topic_words_and_domains(spark):
    rows = [("2024年GDP Report of the 济南市国民经济和社会发展统计公报 数据",), ("AQI x 空气质量 一",), (None,)]
    df = spark.createDataFrame(rows, "c string").select(context.topic_words(F.col("c")).alias("w")).withColumn("d", context.topic_domains(F.col("w")))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (["gdp", "report", "of", "the", "济南市国民经济和社会发展统计公报", "济南市国民经济和", "社会发展统计公报"], ["economy"])
    assert got[1] == (["aqi", "空气质量"], ["air_quality"]) and got[2] == ([], [])


def test_hints(spark):
    text = "城市：南京\n站点: A1；说明文字\n太：长" + "长" * 40 + "\n日期：" + "九" * 35 + "\n城市：苏州\na b：c"
    assert spark.range(1).select(context.filter_hints(F.lit(text))).first()[0] == {"站点": "A1", "日期": "九" * 35, "城市": "苏州"}
    assert spark.range(1).select(context.filter_hints(F.lit(None).cast("string"))).first()[0] == {}


def test_blocks_go_to_the_next_table(spark):
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 4, "c"), (1, 9, "late"), (2, 0, "no table")], "doc_id int, position int, content string")
    tables = spark.createDataFrame([(1, 2), (1, 3), (1, 5), (3, 0)], "doc_id int, position int")
    got = {(r[0], r[1]): r[2] for r in context.descriptions(blocks, tables).collect()}
    assert got == {(1, 2): "a\nb", (1, 3): "", (1, 5): "c", (3, 0): ""}


def _context(spark, anchor, topic=(), hints=None):
    row = ("t", list(anchor), list({*anchor, *topic}), hints or {})
    df = spark.createDataFrame([row], "template string, anchor_words array<string>, topic_words array<string>, hints map<string,string>")
    return df.withColumns({"anchor_domains": context.topic_domains(F.col("anchor_words")), "topic_domains": context.topic_domains(F.col("topic_words"))})


RECORD = "record_id int, template string, source_file string, narrative boolean, snippets array<string>, n_backed int, values map<string,string>"


def test_records_meet_their_template(spark):
    """Of another domain goes, of the same stays, a table's record stays, as does one whose template is unknown; hints count
    for columns of like names, dates in any form."""
    rows = [
        (1, "t", "/in/covid.txt", True, ["确诊病例 12 例"], 3, {"城市": "南京"}),
        (2, "t", "/in/济南经济.md", True, [], 0, {"城市": "南京市"}),
        (3, "t", "/in/covid.csv", False, [], 0, {"城市": "南京"}),
        (4, "u", "/in/covid.txt", True, [], 0, {"城市": "北京"}),
        (5, "t", "/in/经济.txt", True, [], 0, {"城市名": "北京"}),
        (6, "t", "/in/经济.txt", True, [], 0, {"日期": "2024/1/2.0", "城市": ""}),
        (7, "t", "/in/notes.txt", True, ["nothing told"], 1, {"a": "1", "b": "2"}),
        (8, "t", None, True, None, 0, None),
    ]
    ctx = _context(spark, ["济南经济", "经济"], hints={"城市": "南京", "日期": "2024-1-2"})
    out = context.with_context(spark.createDataFrame(rows, RECORD), ctx)
    got = {r["record_id"]: r["reason"] for r in out.collect()}
    assert got == {1: "template_topic_mismatch", 2: "", 3: "", 4: "", 5: "template_filter_mismatch", 6: "", 7: "", 8: ""}
    lost = {r["source_file"]: (r["remaining"], r["dropped"], r["reasons"]) for r in context.context_losses(out).collect()}
    assert lost["/in/covid.txt"] == (1, 1, {"template_topic_mismatch": 1}) and lost["/in/经济.txt"] == (1, 1, {"template_filter_mismatch": 1})
    assert lost["/in/济南经济.md"] == (1, 0, {})
    bare = _context(spark, ["weather"])
    few = {r["record_id"]: r["reason"] for r in context.with_context(spark.createDataFrame(rows, RECORD), bare).collect()}
    assert few[1] == "" and few[7] == "template_topic_mismatch"  # without domains, two fields with evidence are enough
    assert context.with_context(spark.createDataFrame([], RECORD), ctx).count() == 0


def test_scores_of_sources(spark):
    sources = spark.createDataFrame([("b", "GDP of Jinan", "population and budget", 0), ("a", "gdp of jinan", "Population", 0), ("c", "notes", "gdp", 4), ("d", "notes", "other", 8), ("e", "x", None, 0)], "source string, title string, body string, n_signals int")
    contexts = spark.createDataFrame([("t", ["gdp"], ["Pop-ulation", "budget", "x", "数据"], ["Jinan"]), ("u", [], [], [])], "template string, topic_words array<string>, indicators array<string>, entities array<string>")
    got = [tuple(r) for r in context.source_scores(sources, contexts).orderBy("place").collect()]
    assert [g[:5] for g in got] == [("t", "b", 6 + 3 + 2 * 2 + 2 + 1, 2, 1), ("t", "a", 6 + 3 + 2 + 1, 1, 1), ("t", "c", 4, 0, 0)]
    assert context.source_scores(sources, contexts, 1).count() == 1 and context.source_scores(sources.filter("false"), contexts).count() == 0


MAPS = "k string, seq int, source_file string, values map<string,string>, confidences map<string,double>, evidence map<string,array<string>>, methods map<string,string>"


def test_maps_merge(spark):
    rows = [
        ("a", 1, "s1", {"x": "1", "y": " "}, {"x": 0.5, "y": 0.9}, {"x": ["p", "q", "p"]}, {"x": "", "y": "rule"}),
        ("a", 2, "s2", {"x": "2", "y": "yes"}, {"x": 0.55, "y": 0.2}, {"x": ["q", "r"], "y": ["e"]}, {"x": "text", "y": "text"}),
        ("a", 3, "s3", {"x": "2"}, {"x": 0.4}, None, None),
        ("b", 4, "s1", {"x": "v"}, None, None, {"x": "m"}),
        (None, 5, "s1", {"x": "1"}, {"x": 0.5}, {}, {}),
        (None, 6, "s1", {"x": "1"}, {"x": 0.5}, {}, {}),
        ("c", 7, "s1", {}, {}, {}, {}),
        ("d", 8, "s1", None, None, None, None),
    ]
    out = {r["seq"]: r for r in merging.merge_maps(spark.createDataFrame(rows, MAPS), "k", "seq", evidence=2).collect()}
    a = out[1]
    assert a["k"] == "a" and a["n_merged"] == 3 and a["values"] == {"x": "2", "y": "yes"} and a["confidences"] == {"x": 0.55, "y": 0.9}
    assert a["evidence"] == {"x": ["p", "q"], "y": ["e"]} and a["value_sources"] == {"x": ["s2", "s3"], "y": ["s2"]}
    assert a["methods"] == {"x": "text", "y": "rule"} and a["needs_review"] == ["x"]
    assert out[4]["values"] == {"x": "v"} and out[4]["confidences"] == {} and out[4]["needs_review"] == []
    assert out[5]["n_merged"] == out[6]["n_merged"] == 1 and out[5]["k"] is None
    assert out[7]["values"] == {} and out[8]["values"] == {} and len(out) == 6
    assert merging.merge_maps(spark.createDataFrame([], MAPS), "k", "seq").count() == 0


def test_a_hot_record_keeps_two_values_and_a_few_pieces(spark):
    rows = spark.range(20_000).selectExpr("'k' AS k", "cast(id AS int) AS seq", "concat('s', id) AS source_file", "map('x', cast(id AS string)) AS values", "map('x', double(id % 1000) / 1000) AS confidences", "map('x', array(concat('e', id))) AS evidence", "map('x', 'rule') AS methods")
    one = merging.merge_maps(rows, "k", "seq").first()
    assert one["values"] == {"x": "999"} and one["evidence"] == {"x": [f"e{i}" for i in range(5)]} and one["needs_review"] == ["x"] and one["n_merged"] == 20_000


def test_first_distinct(spark):
    rows = [("a", 3, "z"), ("a", 1, "y"), ("a", 2, "y"), ("a", 4, "x"), ("a", 5, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {r["k"]: r["first"] for r in merging.first_distinct(df, ["k"], F.col("v"), F.col("o"), 2, "first").collect()}
    assert got == {"a": ["y", "z"]}


def test_split_by_quality(spark):
    df = spark.createDataFrame([("12", 5), ("city", None), (None, 200)], "name string, n int")
    out = merging.split_by_quality(df, {"entity": F.col("name").rlike("^[0-9]+$"), "range": F.col("n") > 100}).collect()
    assert [(r["quality_flags"], r["stable"]) for r in out] == [(["entity"], False), ([], True), (["range"], False)]
    assert merging.split_by_quality(df, {}).filter("stable").count() == 3


def region_of(text, headers, rows):
    """What the replacement is to give, line by line."""
    d = "\t" if "\t" in text or "," not in text else ","
    lines = text.split("\n")
    new = "\n".join([d.join(headers), *[d.join(r) for r in rows]])
    for i, line in enumerate(lines):
        fields = [f.strip() for f in line.strip().split(d)]
        if line.strip() and len(fields) >= 0.6 * len(headers) and sum(any(h in f or f in h for f in fields) for h in headers) >= 0.5 * len(headers):
            end = i + 1
            while end < len(lines):
                bare = lines[end].strip()
                if (bare and d not in bare) or (not bare and not (end + 1 < len(lines) and d in lines[end + 1].strip())):
                    break
                end += 1
            return "\n".join(p for p in ("\n".join(lines[:i]), new, "\n".join(lines[end:])) if p), True
    return f"{text}\n\n{new}", False


def test_text_regions(spark):
    headers, rng = ["city", "gdp", "year"], random.Random(9)
    parts = ["text", "city,gdp,year", "a,1,2", "", " ", "the city, gdp", "x", "city\tgdp\tyear", "b\t2", ",", "gdp of city,2024"]
    texts = ["", "city,gdp,year", "city,gdp,year\na,1,2\n\nb,2,3\n\n\nc,3", "no table"] + ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, "stays, as it is")], "doc_id int, text string")
    new = [["n", "1"], ["m", "", "3"]]
    tables = spark.createDataFrame([(i, new) for i in range(-1, len(texts))], "doc_id int, rows array<array<string>>")
    got = {r["doc_id"]: (r["text"], r["replaced"]) for r in regions.replace_tables(docs, headers, tables).collect()}
    assert got[-2] == ("stays, as it is", False) and got[-1] == region_of("", headers, new)
    for i, text in enumerate(texts):
        assert got[i] == region_of(text, headers, new), text


def test_evidence_with_rows(spark):
    tables = "name string, headers array<string>"
    templates = spark.createDataFrame([("t", ["城市", "GDP"]), ("u", ["日期"]), ("none", []), ("same", ["城市", "GDP"])], tables)
    sources = spark.createDataFrame([("a", ["城市名", "GDP", " "]), ("b", ["城市名", "GDP", " "]), ("c", ["城市"]), ("d", None), ("e", ["零件"])], tables)
    rows = spark.createDataFrame([("a", 1, {"城市名": "青岛", "GDP": "5"}), ("a", 2, {"城市名": "济南"}), ("b", 1, {"GDP": "7"}), ("c", 1, {"城市": "x"}), ("e", 1, {"零件": "y"})], "source string, row_no long, values map<string,string>")
    got = {(r["template"], r["source"], r["row_no"]): (r["rank"], r["confidence"], r["values"]) for r in pairing.ranked_evidence(templates, sources, rows).collect()}
    assert {k for k in got if k[0] == "t"} == {("t", "a", 1), ("t", "a", 2), ("t", "b", 1)} and {k[0] for k in got} == {"t", "same"}
    assert got["t", "a", 1] == (1, 1.0, {"城市": "青岛", "GDP": "5"}) and got["t", "a", 2][2] == {"城市": "济南", "GDP": None}
    kept = pairing.ranked_evidence(templates, sources, rows, lambda v: F.try_element_at(v, F.lit("GDP")).cast("int") > 5).collect()
    assert {(r["template"], r["source"]) for r in kept} == {("t", "b"), ("same", "b")}


def test_labels_are_plain_text(spark):
    docs = spark.createDataFrame([(1, "a.b: yes\naxb: no\n(c): 3")], "doc_id int, text string")
    got = {(r["label"], r["value"]) for r in narrative.labelled_values(docs, ["a.b", "(c)", "d+"]).collect()}
    assert got == {("a.b", "yes"), ("(c)", "3")}


def test_requirement_nearest_to_the_files(spark):
    paths = [("t", 0, "/a/b/x.xlsx"), ("t", 1, "/c/y.csv"), ("u", 0, "/c/y.csv"), ("v", 0, "z.md"), ("w", 0, "/top.md"), ("n", 0, None), ("o", 0, "/nowhere/at/all")]
    files = [("/a/req.txt", "above"), ("/a/b/req.txt", " "), ("/a/b/other.txt", "no"), ("/c/user.txt", "second\n"), ("/c/req.txt", "first"), ("req.txt", "here"), ("/req.txt", "root"), ("/a/b/user.txt", None)]
    out = lookup.requirements_beside(spark.createDataFrame(paths, "task string, place int, path string"), spark.createDataFrame(files, "path string, text string"), ["req.txt", "user.txt"])
    assert {r["task"]: r["text"] for r in out.collect()} == {"t": "above", "u": "first", "v": "here", "w": "root"}
    assert out.filter("task = 't'").first()["path"] == "/a/req.txt"
