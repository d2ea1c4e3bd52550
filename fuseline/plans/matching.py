"""Queries of comparison by position, of template contexts and of evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuseline.operators import concepts, context, lookup, merging, narrative, pairing, position, regions
from fuseline.operators.context import DOMAIN_WORDS
from fuseline.plans.catalogue import _BLOCKS_SQL, query, t
from fuseline.sources import sinks
from fuseline.sources.scratch import scratch_dir


def _shifted(spark, d):
    """customer as gold; without some rows, with other values in some and further rows at the end as output."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    gold = c.filter("c_custkey % 4 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    late = c.filter("c_custkey % 300 = 7").withColumn("c_custkey", F.col("c_custkey") + 100_000_000)
    out = c.filter("c_custkey % 4 <> 1 AND c_custkey % 1000 <> 999").withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise("?")).unionByName(late).unionByName(late.withColumn("c_custkey", F.col("c_custkey") * 2))
    number = lambda x: position.numbered(x, ["c_custkey"]).drop("c_custkey")
    return number(out).withColumn("note", F.lit("x")), number(gold)


_SHIFTED = """WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer),
late AS (SELECT k + 100000000 AS k, name, bal, seg FROM c WHERE k % 300 = 7),
o AS (SELECT row_number() OVER (ORDER BY k) AS r, * FROM (SELECT k, CASE WHEN k % 7 <> 0 THEN name ELSE '?' END AS name, bal, seg FROM c WHERE k % 4 <> 1 AND k % 1000 <> 999 UNION ALL SELECT * FROM late UNION ALL SELECT 2 * k, name, bal, seg FROM late)),
g AS (SELECT row_number() OVER (ORDER BY k) AS r, k, name, bal, CASE WHEN k % 9 <> 0 THEN seg END AS seg FROM c WHERE k % 4 <> 1),
cell AS (SELECT o.r AS o, g.r AS g, coalesce(o.r, g.r) AS r, unnest(['c_name', 'c_acctbal', 'c_mktsegment', 'note']) AS col, unnest([o.name, round(o.bal, 4)::VARCHAR, o.seg, CASE WHEN o.r IS NOT NULL THEN 'x' END]) AS a,
    unnest([g.name, round(g.bal, 4)::VARCHAR, g.seg, NULL]) AS b FROM o FULL JOIN g ON o.r = g.r),
s AS (SELECT r, col, a, b, CASE WHEN o IS NULL THEN 'missing' WHEN g IS NULL THEN 'extra' WHEN a = b THEN 'equal' ELSE 'different' END AS status FROM cell
    WHERE CASE WHEN o IS NULL THEN b IS NOT NULL WHEN g IS NULL THEN a IS NOT NULL ELSE b IS NOT NULL END)
"""


@query(_SHIFTED + """, n AS (SELECT (SELECT count(*) FROM o) AS no, (SELECT count(*) FROM g) AS ng), w AS (SELECT count(DISTINCT r) FILTER (status = 'different') AS wrong, count(*) FILTER (status = 'equal') AS eq,
    count(*) FILTER (status IN ('equal', 'different')) AS total, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra FROM s)
SELECT no AS output_row_count, ng AS gold_row_count, least(no, ng) AS compared_rows, total AS total_cells, eq AS matched_cells, least(no, ng) - wrong AS matched_rows, missing AS missing_cells, extra AS extra_cells,
    round(eq * 100.0 / total, 2)::DOUBLE AS cell_accuracy, round((least(no, ng) - wrong) * 100.0 / least(no, ng), 2)::DOUBLE AS row_accuracy, eq * 100.0 / total >= 80 AS meets_threshold FROM n, w""")
def gold_positions(spark, d):
    out = position.positional_accuracy(*_shifted(spark, d))
    return out.withColumns({c: F.col(c).cast("double") for c in ("cell_accuracy", "row_accuracy")})


@query(_SHIFTED + "SELECT col AS column_name, status, count(*) AS n, min(r) AS first_row, max(r) AS last_row FROM s GROUP BY ALL")
def gold_position_cells(spark, d):
    cells = position.compare_positions(*_shifted(spark, d))
    return cells.groupBy("column_name", "status").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


# --- contexts ------------------------------------------------------------------------------------

_WORDS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z]{{2,20}}|[一-龥]{{2,24}}'), lambda w: lower(w)))"


def _planted(spark, d):
    """Each document's blocks; every seventh from the sixth on stands for a table."""
    b = narrative.blocks(t(spark, d, "documents")).withColumnRenamed("block_index", "position")
    return b.filter("position % 7 <> 5"), b.filter("position % 7 = 5").select("doc_id", "position", F.array(F.lit("City"), F.lit("GDP total")).alias("headers"))


@query(_BLOCKS_SQL + """, x AS (SELECT doc_id, block_index, content FROM b WHERE block_index % 7 <> 5), g AS (SELECT doc_id, block_index FROM b WHERE block_index % 7 = 5),
u AS (SELECT x.doc_id, g.block_index AS position, string_agg(x.content, chr(10) ORDER BY x.block_index) AS description FROM x ASOF JOIN g ON x.doc_id = g.doc_id AND x.block_index < g.block_index GROUP BY ALL),
h AS (SELECT doc_id, string_agg(content, ' ' ORDER BY block_index) AS heads FROM (SELECT * FROM x WHERE regexp_matches(content, '^#{1,6} ') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_index) <= 2) GROUP BY doc_id),
a AS (SELECT g.doc_id, g.block_index AS position, coalesce(description, '') AS description, concat_ws(' ', 'doc-' || g.doc_id, coalesce(description, ''), heads) AS anchor FROM g LEFT JOIN u ON u.doc_id = g.doc_id AND u.position = g.block_index LEFT JOIN h ON h.doc_id = g.doc_id)
SELECT doc_id, position::INTEGER AS position, description, len(""" + _WORDS.format("anchor") + ") AS n_anchor_words, len(" + _WORDS.format("anchor || ' City GDP total'") + """) AS n_topic_words, true AS about_economy FROM a""")
def table_contexts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/doc-"), "doc_id", F.lit(".txt")).alias("name"))
    found = context.table_contexts(docs, *_planted(spark, d))
    return found.select("doc_id", "position", "description", F.size("anchor_words").cast("long").alias("n_anchor_words"), F.size("topic_words").cast("long").alias("n_topic_words"), F.array_contains("topic_domains", "economy").alias("about_economy"))


#: Templates of the regions: name, description of the table.
_ABOUT = ["gdp overview", "building sites\nsegment：BUILDING", "covid spread", "weather", "machinery trade；segment：MACHINERY"]
_FROM = ["gdp yearbook", "covid bulletin", "weather notes", "building report"]


def _domains_sql(words: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({words}, lambda w: regexp_matches(w, '{'|'.join(of)}'))) > 0 THEN '{d}' END" for d, of in DOMAIN_WORDS.items()) + "], lambda x: x IS NOT NULL)"


def _checked(spark, d):
    about = F.element_at(F.array(*map(F.lit, _ABOUT)), (F.col("r_regionkey") % len(_ABOUT) + 1).cast("int"))
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("template"), about.alias("about"))
    words = context.topic_words(F.col("about"))
    contexts = r.select("template", words.alias("anchor_words"), context.topic_domains(words).alias("anchor_domains"), F.array_union(words, F.array(F.lit("customers"))).alias("topic_words"), context.topic_domains(words).alias("topic_domains"), context.filter_hints(F.col("about")).alias("hints"))
    c = t(spark, d, "customer").join(t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("template")), F.col("c_nationkey") == F.col("n_nationkey"))
    source = F.concat(F.lit("/in/"), F.element_at(F.array(*map(F.lit, _FROM)), (F.col("c_custkey") % len(_FROM) + 1).cast("int")), F.lit(".txt"))
    records = c.select(
        F.col("c_custkey").alias("record_id"), "template", source.alias("source_file"), (F.col("c_custkey") % 5 != 0).alias("narrative"), F.array(F.col("c_mktsegment")).alias("snippets"),
        (F.col("c_custkey") % 4).cast("int").alias("n_backed"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("market segment"), F.col("c_mktsegment")).alias("values"),
    )
    return context.with_context(records, contexts)


_CHECKED = f"""WITH c AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS narrative, n_regionkey AS template, {_FROM!r}[c_custkey % 4 + 1] AS stem, c_mktsegment AS seg, c_custkey % 4 AS backed,
    {[a.split(chr(10))[0].split('；')[0] + (' segment BUILDING' if 'BUILDING' in a else ' segment MACHINERY' if 'MACHINERY' in a else '') for a in _ABOUT]!r}[n_regionkey + 1] AS about, [NULL, 'BUILDING', NULL, NULL, 'MACHINERY'][n_regionkey + 1] AS hint
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, {_WORDS.format('about')} AS aw, {_WORDS.format('stem')} AS own, {_WORDS.format("stem || ' ' || seg")} AS wrd FROM c),
v AS (SELECT *, {_domains_sql('aw')} AS ad, {_domains_sql('own')} AS od, {_domains_sql('wrd')} AS wd FROM w),
k AS (SELECT *, CASE WHEN NOT narrative OR list_has_any(aw, own) OR list_has_any(aw, wrd) THEN true WHEN len(ad) > 0 AND len(od) > 0 AND NOT list_has_any(ad, od) THEN false WHEN list_has_any(list_append(aw, 'customers'), wrd) THEN true
    WHEN len(ad) > 0 AND len(wd) > 0 AND NOT list_has_any(ad, wd) THEN false WHEN len(ad) > 0 AND len(wd) = 0 THEN true ELSE backed >= 2 END AS topic, coalesce(hint <> seg, false) AS against FROM v),
z AS (SELECT id, '/in/' || stem || '.txt' AS source_file, CASE WHEN NOT topic THEN 'template_topic_mismatch' WHEN against THEN 'template_filter_mismatch' ELSE '' END AS reason FROM k)
"""


@query(_CHECKED + "SELECT id AS record_id, source_file, reason FROM z")
def context_filter(spark, d):
    return _checked(spark, d).select("record_id", "source_file", "reason")


@query(_CHECKED + "SELECT source_file, count(*) FILTER (reason = '') AS remaining, count(*) FILTER (reason <> '') AS dropped, count(*) FILTER (reason = 'template_topic_mismatch') AS n_topic, count(*) FILTER (reason = 'template_filter_mismatch') AS n_filter FROM z GROUP BY 1")
def context_losses(spark, d):
    out = context.context_losses(_checked(spark, d))
    n = lambda r: F.coalesce(F.try_element_at("reasons", F.lit(r)), F.lit(0)).cast("long")
    return out.select("source_file", "remaining", "dropped", n("template_topic_mismatch").alias("n_topic"), n("template_filter_mismatch").alias("n_filter"))


#: Templates that ask the documents: topic words, indicators, entities.
_ASKED = [("licences", ["licensed", "copyright"], ["licensed", "rights", "all"], ["license"]), ("contacts", ["phone", "mail", "contact"], ["phone", "e-mail"], ["street"]), ("prose", ["the", "thing"], ["thati", "ing of"], ["and"]), ("none", ["zzzz"], ["qqqq"], [])]
_MARKS_SQL = r"regexp_replace(lower({0}), '[\s_\-:：,，、/\\()（）\[\]【】]+', '', 'g')"


def _scores_sql() -> str:
    strip = lambda x: "".join(ch for ch in x.lower() if ch not in " -_")
    rows = []
    for name, words, indicators, entities in _ASKED:
        n = lambda xs, test: " + ".join([f"({test.format(strip(x))})::INT" for x in xs]) or "0"
        wt, wb = (f"len(list_intersect({w}, {words!r}))" for w in ("tw", "bw"))
        it, ib = n(indicators, "contains(tt, '{0}')"), n(indicators, "contains(tt, '{0}') OR contains(bt, '{0}')")
        et, eb = n(entities, "contains(tt, '{0}')"), n(entities, "contains(tt, '{0}') OR contains(bt, '{0}')")
        rows.append(f"SELECT '{name}' AS template, source, sig, {wt} AS wt, {wb} AS wb, ({it}) AS it, ({ib}) AS ni, ({et}) AS et, ({eb}) AS ne FROM p")
    return f"""WITH p AS (SELECT 'doc' || doc_id AS source, doc_id % 6 AS sig, {_WORDS.format("source || ' ' || lang")} AS tw, {_WORDS.format('text')} AS bw, {_MARKS_SQL.format("source || ' ' || lang")} AS tt, {_MARKS_SQL.format('text')} AS bt
    FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)),
r AS ({' UNION ALL '.join(rows)}),
s AS (SELECT *, CASE WHEN wt > 0 THEN 5 + least(wt, 4) WHEN wb > 0 THEN 3 + least(wb, 3) ELSE -1 END + 3 * it + 2 * (ni - it) + 3 * et + (ne - et) + CASE WHEN ni >= 2 THEN 2 ELSE 0 END + CASE WHEN ni > 0 AND ne > 0 THEN 1 ELSE 0 END AS q FROM r WHERE wt + wb + ni + ne > 0)
SELECT template, source, (CASE WHEN q >= 3 THEN q WHEN sig >= 3 AND ni >= 1 THEN q + 2 WHEN sig >= 4 THEN q + 1 ELSE q END)::BIGINT AS score, ni::BIGINT AS n_indicators, ne::BIGINT AS n_entities, row_number() OVER (PARTITION BY template ORDER BY score DESC, source) AS place FROM s QUALIFY place <= 4"""


@query(_scores_sql().replace("AS place FROM s QUALIFY place <= 4", "::INTEGER AS place FROM s QUALIFY place <= 4"))
def source_scores(spark, d):
    docs = t(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("source"), F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("title"), F.coalesce("text", F.lit("")).alias("body"), (F.col("doc_id") % 6).alias("n_signals"))
    asked = spark.createDataFrame(_ASKED, "template string, topic_words array<string>, indicators array<string>, entities array<string>")
    return context.source_scores(docs, asked)


# --- records as maps, tables in texts ------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS s, l_returnflag AS flag, CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS status, (l_partkey % 10) / 10.0 AS c, 'f' || l_suppkey % 3 AS src, 'p' || l_partkey % 7 AS ev FROM lineitem),
v AS (SELECT k, s, unnest(['flag', 'status']) AS field, unnest([flag, status]) AS value, c, src, ev FROM l),
p AS (SELECT * FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, field, value ORDER BY c DESC, s) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY c DESC, s) AS place FROM p),
w AS (SELECT a.k, a.field, a.value, coalesce(b.c > a.c - 0.08 AND b.src <> a.src, false) AS review FROM r a LEFT JOIN r b ON b.k = a.k AND b.field = a.field AND b.place = 2 WHERE a.place = 1),
e AS (SELECT k, string_agg(ev, ',' ORDER BY s) AS evidence FROM (SELECT * FROM (SELECT k, ev, min(s) AS s FROM l GROUP BY k, ev) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) <= 5) GROUP BY k),
n AS (SELECT k, count(*) AS n, max(c)::DOUBLE AS c FROM l GROUP BY k)
SELECT n.k AS l_orderkey, n.n AS n_merged, n.c AS confidence, max(value) FILTER (field = 'flag') AS flag, max(value) FILTER (field = 'status') AS status, e.evidence, coalesce(string_agg(field, ',' ORDER BY field) FILTER (review), '') AS review FROM n JOIN e USING (k) LEFT JOIN w USING (k) GROUP BY n.k, n.n, n.c, e.evidence""")
def merged_maps(spark, d):
    lines = position.numbered(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "seq")
    c = (F.col("l_partkey") % 10 / 10.0).cast("double")
    both = lambda a, b: F.create_map(F.lit("flag"), a, F.lit("status"), b)
    piece = F.array(F.concat(F.lit("p"), F.col("l_partkey") % 7))
    records = lines.select("l_orderkey", "seq", F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("source_file"), both(F.col("l_returnflag"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus"))).alias("values"), both(c, c).alias("confidences"), F.create_map(F.lit("flag"), piece).alias("evidence"), both(F.lit("rule"), F.lit("rule")).alias("methods"))
    out = merging.merge_maps(records, "l_orderkey", "seq")
    get = lambda m, f: F.try_element_at(m, F.lit(f))
    return out.select("l_orderkey", "n_merged", get("confidences", "flag").alias("confidence"), get("values", "flag").alias("flag"), get("values", "status").alias("status"), F.concat_ws(",", get("evidence", "flag")).alias("evidence"), F.concat_ws(",", "needs_review").alias("review"))


_HEADERS = ["name", "value", "unit"]


@query("""WITH x AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(9), ' '), ',', ' ') AS body FROM documents),
y AS (SELECT doc_id, body, body || chr(10) || 'name' || chr(9) || 'value' || chr(9) || 'unit' || chr(10) || 'old' || chr(9) || '1' || chr(9) || 'x' || chr(10) || chr(10) || 'old' || chr(9) || '2' || chr(9) || 'y' || chr(10) || 'after ' || doc_id AS planted FROM x),
n AS (SELECT *, 'name' || chr(9) || 'value' || chr(9) || 'unit' || chr(10) || 'doc' || chr(9) || doc_id || chr(9) || 'id' AS fresh FROM y)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN body || chr(10) || chr(10) || fresh WHEN doc_id % 3 = 1 THEN body || chr(10) || fresh || chr(10) || 'after ' || doc_id ELSE planted END AS text, doc_id % 3 = 1 AS replaced FROM n WHERE body <> ''""")
def text_regions(spark, d):
    body = F.translate(F.coalesce("text", F.lit("")), "\t,", "  ")
    table = F.concat(F.lit("\nname\tvalue\tunit\nold\t1\tx\n\nold\t2\ty\nafter "), "doc_id")
    docs = t(spark, d, "documents").withColumn("body", body).filter("body <> ''").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("body")).otherwise(F.concat("body", table)).alias("text"))
    new = docs.filter("doc_id % 3 <> 2").select("doc_id", F.array(F.array(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("id"))).alias("rows"))
    return regions.replace_tables(docs, _HEADERS, new)


#: Columns of 21 concepts, and what a text is given for some of them.
_ASKED_HEADERS = ["城市", "国家/地区", "省份", "区县", "名称", "GDP总量", "常住人口", "人均GDP", "一般公共预算收入", "一般公共预算支出", "病例数", "每日检测数", "AQI", "PM10", "PM2.5", "首要污染物", "污染类型", "大洲", "日期", "占比", "备注"]


@query(r"""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[0-9:=：]', ' ', 'g') AS body FROM documents)
SELECT doc_id, '青岛市' AS city, doc_id || ' 亿元' AS gdp, (doc_id % 97) || ' 万人' AS people, '2024-03-0' || (1 + doc_id % 9) AS day, CASE WHEN doc_id % 2 = 0 THEN '臭氧' ELSE '' END AS pollutant, (doc_id % 300)::VARCHAR AS aqi FROM x""")
def concept_values(spark, d):
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9:=：]", " ")
    end = F.when(F.col("doc_id") % 2 == 0, "；首要污染物：臭氧").otherwise("")
    content = F.concat(F.lit("青岛市地区生产总值达 "), "doc_id", F.lit(" 亿元，常住人口 "), F.col("doc_id") % 97, F.lit(" 万人。\n"), body, F.lit("\n监测时间：2024-03-0"), 1 + F.col("doc_id") % 9, end, F.lit("；本日测得的 AQI: "), F.col("doc_id") % 300)
    segments = t(spark, d, "documents").select("doc_id", F.lit(0).alias("block_index"), content.alias("content"))
    found = concepts.header_records(segments, _ASKED_HEADERS)
    names = {"city": "城市", "gdp": "GDP总量", "people": "常住人口", "day": "日期", "pollutant": "首要污染物", "aqi": "AQI"}
    return found.select("doc_id", *[F.coalesce(F.try_element_at("values", F.lit(h)), F.lit("")).alias(c) for c, h in names.items()])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def workbook_rows(spark, d):
    """customer written to workbooks and read from them."""
    sinks.register(spark)
    path = scratch_dir(spark)
    t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.format("xlsx").mode("append").option("max_rows", 5000).save(path)
    cell = lambda i: F.get("cells", F.lit(i))
    return sinks.read_workbooks(spark, path).filter("row_no > 0").select(cell(0).cast("long").alias("c_custkey"), cell(1).alias("c_name"), F.when(cell(2) != "", cell(2)).alias("c_mktsegment"))


#: Header rows of the orders' tables by o_orderkey % 3, and of two templates.
_KINDS = [["订单号", "客户", "金额(元)"], ["日期", "地区"], ["客户名称", "金额"]]
_WANTED = [("invoice", ["客户", "金额", "订单号", "备注"]), ("calendar", ["日期", "地区"])]


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 AS kind FROM orders), n AS (SELECT count(*) FILTER (kind = 0) AS n0 FROM s),
r AS (SELECT k, kind, l_linenumber AS row_no, l_partkey AS tie, l_suppkey, l_quantity, l_shipdate FROM s JOIN lineitem ON l_orderkey = k)
SELECT 'invoice' AS template, k AS source, (CASE kind WHEN 0 THEN 1 ELSE 1 + n0 END)::INTEGER AS rank, CASE kind WHEN 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, row_no::BIGINT AS row_no, 's' || l_suppkey AS first, l_quantity::INTEGER::VARCHAR AS second FROM r, n WHERE kind IN (0, 2) AND l_quantity >= 25
UNION ALL SELECT 'calendar', k, 1, 1.0, row_no, l_shipdate::DATE::VARCHAR, 'p' || tie FROM r WHERE kind = 1""")
def ranked_evidence(spark, d):
    """Every order is a source table of one of three kinds, its lines are the rows; invoices take those of at least 25 pieces."""
    kinds = F.array(*[F.array(*map(F.lit, k)) for k in _KINDS])
    kind = (F.col("o_orderkey") % 3).cast("int")
    sources = t(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.get(kinds, kind).alias("headers"))
    pieces = F.col("l_quantity").cast("int").cast("string")
    maps = [(["订单号", "客户", "金额(元)"], [F.col("l_orderkey").cast("string"), F.concat(F.lit("s"), "l_suppkey"), pieces]), (["日期", "地区"], [F.to_date("l_shipdate").cast("string"), F.concat(F.lit("p"), "l_partkey")]), (["客户名称", "金额"], [F.concat(F.lit("s"), "l_suppkey"), pieces])]
    values = F.coalesce(*[F.when(F.col("l_orderkey") % 3 == k, F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*cols))) for k, (names, cols) in enumerate(maps)])
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").cast("long").alias("row_no"), values.alias("values"))
    templates = spark.createDataFrame(_WANTED, "name string, headers array<string>")
    enough = lambda v: F.coalesce(F.try_element_at(v, F.lit("金额")).cast("int") >= 25, F.lit(True))
    found = pairing.ranked_evidence(templates, sources, rows, enough)
    get = lambda *names: F.coalesce(*[F.try_element_at("values", F.lit(n)) for n in names])
    return found.select("template", "source", F.col("rank").cast("int").alias("rank"), "confidence", "row_no", get("客户", "日期").alias("first"), get("金额", "地区").alias("second"))


_FILES = ["requirement.txt", "user_requirement.txt"]


@query("""WITH f AS (SELECT doc_id, '/data/s' || doc_id || CASE doc_id % 3 WHEN 0 THEN '/l0' WHEN 1 THEN '' ELSE '/l1' END AS folder, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS name, trim(coalesce(text, ''), e' \t\n\r') AS text FROM documents),
p AS (SELECT c_custkey AS task, unnest([0, 1]) AS place, unnest(['/data/s' || c_custkey % 300 || '/l' || c_custkey % 2, '/data/s' || (c_custkey + 1) % 300 || '/l0']) AS own FROM customer),
d AS (SELECT task, place, 0 AS level, own AS folder FROM p UNION ALL SELECT task, place, 1, regexp_replace(own, '/[^/]*$', '') FROM p)
SELECT task, f.folder || CASE name WHEN 1 THEN '/requirement.txt' ELSE '/user_requirement.txt' END AS path, text FROM d JOIN f USING (folder) WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY task ORDER BY place, level, name, f.folder) = 1""")
def requirements_beside(spark, d):
    """Documents lie beside or above the files of tasks, one for each customer."""
    k = F.col("doc_id")
    folder = F.concat(F.lit("/data/s"), k, F.when(k % 3 == 0, "/l0").when(k % 3 == 1, "").otherwise("/l1"))
    files = t(spark, d, "documents").select(F.concat(folder, F.lit("/"), F.when(k % 2 == 0, _FILES[0]).otherwise(_FILES[1])).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    c = F.col("c_custkey")
    own = F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("/data/s"), c % 300, F.lit("/l"), c % 2, F.lit("/t.xlsx")).alias("path")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("/data/s"), (c + 1) % 300, F.lit("/l0/x.txt")).alias("path")))
    return lookup.requirements_beside(t(spark, d, "customer").select(c.alias("task"), F.inline(own)), files, _FILES)
