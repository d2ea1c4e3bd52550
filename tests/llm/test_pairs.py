"""Operators that find copies: line dedup, n-gram join, embedding join, components."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from conftest import rows_of

from fuseline.llm import embedding_join, line_dedup, queries, shingle_join
from fuseline.llm.common import WORD_RE, hash_words, joined, shingle_sets, word_hashes
from fuseline.llm.graph import components

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_shingle_join", "op6_embedding_range_join", "op7_quality_rules"])
def test_query_gives_what_its_sql_gives(name, spark, data, duck):
    assert rows_of(queries.queries()[name](spark, data).toPandas()) == rows_of(duck.sql(SQL[name]).df())


def docs_of(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("n_links", "rep", "leaf", "gone", "row", "id", "copies", "score", "n", "text_hash", "lines", "kept"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


# --- lines ---------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(60))


def test_lines_defined_cases(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", LONG, f"q\n{LONG}\nr", None, "", "a\nb", "a\na\na\na\na\na", "a\nb\nc\nd"]
    df = docs_of(spark, texts, extra=True)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [out[i]["text"] for i in range(9)] == ["a\nb\nc\nd", "x\ny", LONG, "q\nr", None, "", "a\nb", "a", ""]
    assert out[1]["n_removed"] == 4 and out[4]["n_lines"] == 0 and out[5]["n_lines"] == 1 and out[0]["gone"] == "x"
    assert sorted(line_dedup.dedup_lines(df).columns) == sorted([*df.columns, "n_lines", "n_removed"])


def test_lines_of_repeated_rows_and_null_ids(spark):
    text = "k1\nk2\nk3\nk4"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, text), (1, text), (1, text), (2, "")]
    assert line_dedup.dedup_lines(df.filter("false")).count() == 0


def test_every_long_run_is_found(spark):
    """A run of min_words words, or of min_lines + window - 1 lines, is deleted wherever it stands."""
    rng = random.Random(3)
    texts = []
    run = [f"short {i}" for i in range(4)]
    for d in range(30):
        own = [f"line {d} {i} " + " ".join(str(rng.random()) for _ in range(rng.randint(0, 9))) for i in range(rng.randint(1, 9))]
        at = rng.randint(0, len(own))
        texts.append("\n".join(own[:at] + (run if d % 2 else [LONG]) + own[at:]))
    out = line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()
    for d, r in enumerate(out):
        gone = [x for x in texts[d].split("\n") if x in run or x == LONG] if d > 1 else []
        assert r["text"].split("\n") == [x for x in texts[d].split("\n") if x not in gone]


@pytest.mark.parametrize("period", [["a"], ["a", "b"], ["x", "x", "x", "x", "y"], [f"{i}" for i in range(997)]])
def test_lines_of_very_many_repeats(spark, period):
    """The work grows with the lines: one period stays, in the first document."""
    lines = (period * (100_000 // len(period) + 1))[:100_000]
    began = time.time()
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(docs_of(spark, ["\n".join(lines), "top\n" + "\n".join(lines[:50_000]) + "\nend"])).collect()}
    assert out[1] == ["top", "end"] and len(out[0]) <= 2 * len(period) and out[0][: len(period)] == period and set(out[0]) == set(period)
    assert time.time() - began < 60


def test_lines_of_many_shifts(spark, duck):
    """100,000 lines of seven kinds, which repeat at thousands of distances; a shorter text is held against the SQL."""
    rng = random.Random(5)
    lines = [f"kind {rng.randrange(7)}" for _ in range(100_000)]
    began = time.time()
    out = line_dedup.dedup_lines(docs_of(spark, ["\n".join(lines)])).first()
    assert out["n_lines"] == 100_000 and out["n_removed"] > 90_000 and time.time() - began < 40
    few_lines = docs_of(spark, ["\n".join(lines[:1500]), "\n".join(lines[700:2000])]).toPandas()  # noqa: F841
    want = duck.sql(line_dedup.SQL.format(docs="few_lines") + "SELECT doc_id, coalesce(text, '') AS text, n_removed FROM kept ORDER BY doc_id").fetchall()
    got = line_dedup.dedup_lines(docs_of(spark, ["\n".join(lines[:1500]), "\n".join(lines[700:2000])])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_removed"]) for r in got] == want


def test_lines_against_sql(spark, duck):
    """Texts of few different lines, so that runs repeat within and between them at many distances."""
    rng = random.Random(8)
    rows = [(i // 2, "\n".join(rng.choice(["a", "b", "c", "long " * 60, ""]) for _ in range(rng.randint(1, 40)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few_lines = df.toPandas()  # noqa: F841
    want = duck.sql(line_dedup.SQL.format(docs="few_lines") + "SELECT doc_id, text_hash, coalesce(text, '') AS text, n_lines, n_removed FROM kept").df()
    got = line_dedup.deduplicated(df).selectExpr("row.doc_id AS doc_id", "CAST(conv(substring(md5(row.text), 1, 15), 16, 10) AS LONG) AS text_hash", "text", "n_lines", "n_removed").distinct()
    assert rows_of(got.toPandas()) == rows_of(want)


# --- shingles ------------------------------------------------------------------------------------


def brute_links(texts, words=5, similarity=0.8):
    sets = []
    for t in texts:
        w = WORD_RE.findall(t or "")
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and len(a & b) >= similarity * len(a | b) - 1e-9}


def classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def near_texts(seed, groups=12, most=12):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 60)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    return texts


def check(spark, texts, **options):
    got = shingle_join.similar_documents(docs_of(spark, texts, extra=True), **options).orderBy("doc_id").collect()
    links = brute_links(texts)
    label = classes(len(texts), links)
    assert [r["class_id"] for r in got] == label
    assert [r["n_links"] for r in got] == [sum(i in p for p in links) for i in range(len(texts))]
    assert [r["kept"] for r in got] == [c == i for i, c in enumerate(label)]


def test_shingles_against_brute_force(spark):
    check(spark, near_texts(1) + [None, "", " \n ", "one two", "one two", "one\ttwo", "é ñ ß"])


def test_shingles_with_splits_and_tiles(spark, monkeypatch):
    """Small limits: nodes are split, leaves are dealt out in tiles by rows and by tokens, sets are
    joined by a shuffle, and nothing is lost or doubled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        check(spark, near_texts(2, groups=4, most=40), limit=6, block=5, depth=3)
        monkeypatch.setattr(shingle_join, "TOKENS", 100)
        check(spark, near_texts(3, groups=3, most=20), limit=6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shingles_of_empty_and_repeated_rows(spark):
    none = docs_of(spark, ["a b c d e f"]).filter("false")
    assert shingle_join.similar_documents(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_links"], r["kept"]) for r in shingle_join.similar_documents(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 0, True)]
    assert sorted((r["doc_id"] or 0) for r in shingle_join.drop_copies(df).collect()) == [0, 1, 2]


def test_shingles_of_rows_that_share_an_id(spark):
    """Rows that share a doc_id but not a text link by their texts, each as a document of its own."""
    texts = near_texts(5, groups=6, most=8) + ["same words in two of the rows"] * 2
    ids = [i // 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    links, got = brute_links(texts), {}
    label = classes(len(texts), links)
    for r in shingle_join.similar_documents(df).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    least = {c: min(ids[i] for i in range(len(texts)) if label[i] == c) for c in label}
    want = {}
    for i, d in enumerate(ids):
        want.setdefault(d, []).append((least[label[i]], sum(i in p for p in links)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    left = shingle_join.drop_copies(df).collect()
    assert len(left) == len(set(label)) and {label[texts.index(r["text"])] for r in left} == set(label)
    one = spark.createDataFrame([(1, "a b c"), (1, "d e f")], "doc_id long, text string")
    assert sorted(map(tuple, shingle_join.similar_documents(one).collect())) == [(1, 1, 0, True)] * 2 and shingle_join.drop_copies(one).count() == 2


def test_runs_reach_the_target():
    assert shingle_join.survival(0.8, 2, 1) == pytest.approx(0.96)
    runs = shingle_join.runs_needed(0.8, 2, 3, 0.9995)
    assert (1 - shingle_join.survival(0.8, 2, 3)) ** runs <= 0.0005


def test_word_hashes():
    texts = ["", "a  b\ta", "  ", "ab é\x0bé", "x" * 200_000]
    h, at = word_hashes(texts)
    assert np.diff(at).tolist() == [0, 3, 0, 3, 1] and h[0] == h[2] != h[1] and h[4] == h[5]
    assert [len(s) for s in shingle_sets(["a b c d e f a b c d e f", "a b", ""], 5)] == [6, 1, 0]
    assert np.array_equal(shingle_sets(["p q", "a b c d e"], 5)[1], shingle_sets(["a b c d e"], 5)[0])


def test_word_hashes_in_parts():
    texts = ["", "a bb ccc " * 40, "y" * 99, " z"]
    buf, ends = joined(texts)
    whole, at = hash_words(buf, ends)
    for limit in (1, 7, 50):
        part, at2 = hash_words(buf, ends, limit)
        assert np.array_equal(whole, part) and np.array_equal(at, at2)


def test_components(spark):
    links = [(i + 1, i) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((100, 200, 300), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings ----------------------------------------------------------------------------------


def check_vectors(spark, vectors, block, kind="float"):
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS rep", "2 AS n", "3 AS links", "4 AS cell", "5 AS lead", "6 AS least", "7 AS id", "8 AS role")
    got = embedding_join.near_embeddings(df, block=block).orderBy("vec_id").collect()
    sound = {i: np.asarray(v, np.float32 if kind == "float" else np.float64).astype(np.float64) / np.abs(v).max() for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(i, j) for (i, a), (j, b) in itertools.combinations(sound.items(), 2) if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9}
    label = classes(len(vectors), links)
    assert [(r["component_id"], r["n_links"], r["kept"]) for r in got] == [(c, sum(i in p for p in links), c == i) for i, c in enumerate(label)]


@pytest.mark.parametrize("block", [8, 25, 4096])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    near = [c + rng.normal(scale=s, size=8) for c in centres for s in (0.02, 0.1, 0.3) for _ in range(6)]
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0, None] * 4, [1.0, 2.0], [2.0, 4.0], []]
    check_vectors(spark, [list(map(float, v)) for v in near + [near[0]] * 9 + [near[0] * 3]] + odd, block)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_join.near_embeddings(df).collect()))
    assert got == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_vectors_at_the_limit(spark):
    """Ties: a product of just 0.9 links, the next smaller one doesn't."""
    y = float(np.sqrt(1 - 0.81))
    over = [[0.9 + e, y] for e in (-1e-6, 0.0, 1e-6)]
    check_vectors(spark, [[1.0, 0.0], *over, [3.0, 0.0]], 4096, "double")


def test_vectors_in_double(spark):
    check_vectors(spark, [[1e300, 1e300], [1.0, 1.0], [1e-300, 0.0]], 4, "double")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_join.near_embeddings(none).count() == 0
