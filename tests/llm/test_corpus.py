"""Mixing and the pipeline."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_pairs import brute_links, classes
from tokenizers import Tokenizer

from fuseline.llm import line_dedup, mixing, quality_classifier
from fuseline.llm.common import WORD, WORD_RE, word_hashes
from fuseline.llm.tokens import tokenizer_path


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}
    got = mixing.targets({"b": 10, None: 1000, "a": 1})
    assert got["a"] == 2 and got["b"] == 20 and got[None] == pytest.approx(1.5 * 1011 - 22)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_rounding():
    sizes = [1000, 500, 400, 100, 50, 3, 2, 1, 0]
    copies = mixing.round_rates(sizes, [0.3, 1.5, 0.7, 1.2, 0.1, 0.5, 1.9, 0.4, 1.0])
    want = sum(s * r for s, r in zip(sizes, [0.3, 1.5, 0.7, 1.2, 0.1, 0.5, 1.9, 0.4, 1.0], strict=True))
    assert all(0 <= c <= 2 for c in copies) and abs(sum(s * c for s, c in zip(sizes, copies, strict=True)) - want) <= 100
    assert mixing.round_rates([5, 5], [2.0, 0.0]) == [2, 0]


def test_mix(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, two = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert one.equals(two)
    per = one.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken / per.target - 1).abs() < 0.03).all() and (one.taken <= 2 * one["size"]).all()
    assert one.target.groupby(one.source).first().sum() == pytest.approx(1.5 * one["size"].sum())


def test_rates_are_tilted_and_meet_the_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "ab"[i % 3 == 0]) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in out.groupby("source"):
        assert (g.rate * g["size"]).sum() == pytest.approx(g.target.iloc[0], rel=1e-6)
        assert g.groupby("size").rate.nunique().max() == 1


def test_mix_of_many_equal_rows(spark):
    """A third of all rows are one row: they share their copies evenly, and other splits of the rows
    give the same."""
    rows = [(7, "w " * 9, "a")] * 500 + [(i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix(x, group=100).collect())) for x in (df, df.repartition(7, "text").orderBy("text")))
    assert one == two and len(one) == 1500
    per = {}
    for d, s, size, _, target, rate, copies, taken in one:
        assert taken == copies * size and abs(copies - rate) < 2 and 0 <= copies <= 2
        per[s] = (per.get(s, (0, 0))[0] + taken, target)
    assert all(abs(t / g - 1) < 0.01 for t, g in per.values())
    assert mixing.mix(df, with_docs=True, group=100).groupBy("doc_id", "text").count().filter("doc_id = 7 AND length(text) = 18").first()["count"] == sum(r[6] for r in one if r[0] == 7 and r[2] == 9)


#: What op9's contract says of sizes and targets, round by round of the excess.
MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
step AS (SELECT 0 AS k, source, words, weight, NULL::DOUBLE AS fixed FROM s
    UNION ALL SELECT k + 1, source, words, weight, coalesce(fixed, CASE WHEN weight * (1.5 * sum(words) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(weight) FILTER (fixed IS NULL) OVER () > 2 * words THEN 2 * words END) FROM step WHERE k < 100),
last AS (SELECT source, words, coalesce(fixed, weight * (1.5 * sum(words) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(weight) FILTER (fixed IS NULL) OVER ()) AS target FROM step WHERE k = 100)
SELECT d.doc_id, d.size, last.words::BIGINT AS source_size, last.target FROM d JOIN last ON d.source IS NOT DISTINCT FROM last.source
"""


def test_mix_sizes_and_targets_against_sql(spark, data, duck):
    got = mixing.mix(spark.read.parquet(f"{data}/documents.parquet")).toPandas().sort_values("doc_id")
    want = duck.sql(MIX_SQL).df().sort_values("doc_id")
    for c in ("doc_id", "size", "source_size"):
        assert got[c].tolist() == want[c].tolist()
    assert got.target.tolist() == pytest.approx(want.target.tolist(), rel=1e-12)
    assert ((got.copies - got.rate).abs() < 2).all() and got.copies.between(0, 2).all()


def test_mix_cases(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 500, None), (5, "e", "y"), (5, "e", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copies", "2 AS rate", "3 AS _row", "4 AS whole")
    out = mixing.mix(df)
    assert out.count() == 6 and out.filter("size = 0").agg(F.sum("taken")).first()[0] == 0
    again = mixing.mix(df, with_docs=True)
    assert again.columns == df.columns and again.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix(df.filter("false")).count() == 0 and mixing.mix(df.filter("doc_id = 2")).count() == 1


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "shingle_join", "mixing", "best_fit_packing"]
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in docs.select("doc_id").distinct().collect()}
        assert ids <= {r[0] for r in before.select("doc_id").distinct().collect()}
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            good = labels.filter("quality = 1").join(before, "doc_id", "left_semi").count()
            assert labels.filter("quality = 1").join(docs, "doc_id", "left_semi").count() >= 0.97 * good
        if name == "line_dedup":
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "shingle_join":
            assert docs.groupBy("text").count().filter("count > 1 and text <> ''").count() == 0
    sequences = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sequences.filter("n > 1024").count() == 0
    assert sequences.count() <= 1.02 * docs.agg(F.sum("length")).first()[0] / 1024 + 2


CLASHING = ("row", "score", "rep", "lead", "leaf", "kept", "gone", "id", "copies", "rate", "whole", "size", "start", "length", "sequence_id", "quality", "n")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def odd_docs(spark):
    near = " ".join(f"word{i}" for i in range(90))
    rows = [(1, near, "en", "a", 1), (2, near + " more", "en", "a", 2), (2, near + " again", "en", None, 3), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "x " * 60_000, "de", "b", 5)]
    rows += [(6, "same\nsame\n" * 3, "fr", "b", 6)] * 2 + [(None, near, "en", "a", 7), (None, None, None, None, None), (7, "line one\n" * 400, "en", "b", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(name, spark, data, tmp_path):
    """Nulls in any column, rows that share an id or repeat, long texts, clashing columns, empty tables."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_docs(spark)
    ids = [1, 2, 3, 4, 5, 6, 7]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path)).collect()
    assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
    got = sorted(r["doc_id"] or 0 for r in out)
    if name == "quality_classifier":
        assert set(got) <= {0, *ids} and len(out) < docs.count()
    if name == "line_dedup":
        assert got == [0, 0, 1, 2, 2, 3, 4, 5, 6, 6, 7] and {r["doc_id"]: r["text"] for r in out}[7] == "line one\n" and out[0].asDict().keys() == docs.first().asDict().keys()
    if name == "shingle_join":
        assert got == [0, 0, 1, 3, 4, 5, 6, 7] and all(r["kept"] == "x" for r in out)
    if name == "mixing":
        assert set(got) <= {0, *ids} and max(got.count(i) for i in (1, 3, 4, 5, 7)) <= 2 and got.count(2) <= 4
    if name == "best_fit_packing":
        assert len({(r["doc_id"], r["piece"]) for r in out}) > 60 and sum(r["piece"] == 0 for r in out) == docs.count()


def test_run_against_brute_force(spark, data, duck):
    """run()'s pieces are those of documents that plain code scores, SQL dedups, all pairs compare and
    the plain tokenizer cuts; only the mix's copies are the operator's, whose totals must meet the targets."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*COLUMNS)
    model = quality_classifier.learn(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r for r in docs.collect() if naive_score(r["text"] or "", model) >= 0.7]
    scored = pd.DataFrame([(r["doc_id"], r["text"]) for r in rows], columns=["doc_id", "text"])  # noqa: F841
    sql = line_dedup.SQL.format(docs="scored") + "SELECT doc_id, coalesce(text, '') AS text, n_removed FROM kept"
    clean = duck.sql(sql).df()
    source = {r["doc_id"]: r["source"] for r in rows}
    clean = clean[(clean.n_removed == 0) | clean.text.str.contains(WORD)].sort_values("doc_id").reset_index(drop=True)
    label = classes(len(clean), brute_links(clean.text.tolist()))
    left = clean[[c == i for i, c in enumerate(label)]].assign(source=lambda d: d.doc_id.map(source))
    mixed = mixing.mix(spark.createDataFrame(left[["doc_id", "text", "source"]], "doc_id long, text string, source string")).toPandas()
    per = mixed.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken / per.target - 1).abs() < 0.05).all()
    encode, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode, Counter()
    text = dict(zip(left.doc_id, left.text, strict=True))
    for doc_id, copies in zip(mixed.doc_id, mixed.copies, strict=True):
        ids = encode(text[doc_id], add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += int(copies)
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = out.collect()
    assert Counter(tuple(r)[:5] for r in out) == +want
    at = {}
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in out):
        assert at.get(s, 0) == o
        at[s] = o + n
    assert max(at.values()) <= 1024 and len(at) <= 1.02 * sum(at.values()) / 1024 + 2


M64 = (1 << 64) - 1


def naive_mix(x):
    """common.mix64 for one number."""
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & M64
    return x ^ (x >> 32)


def naive_features(text, bits):
    """quality_classifier.features for one text, gram by gram."""
    hash_of = lambda w: int(word_hashes([w])[0][0])
    shape = re.sub(rb"A+|a+|0+", lambda m: m[0][:1], bytes(quality_classifier._SHAPE[np.frombuffer(text.encode(), np.uint8)])).decode("latin-1")
    words, shapes, out = [hash_of(w) for w in WORD_RE.findall(text)], [hash_of(w) for w in WORD_RE.findall(shape)], set()
    for of, n, kind in ((words, 1, 1), (words, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)):
        for i in range(len(of) - n + 1):
            h = naive_mix((of[i] + kind) & M64)
            for k in range(1, n):
                # the gram before it of the same kind, then this word
                h = naive_mix((h * 0x9E3779B97F4A7C15 + of[i + k]) & M64)
            out.add(h >> (64 - bits))
    same = [words[i] == words[i + 1] for i in range(len(words) - 1)]
    for found, kind in ((any(same), 7), (any(a and b for a, b in zip(same, same[1:], strict=False)), 8)):
        if found:
            out.add(naive_mix(kind) >> (64 - bits))
    return sorted(out)


def naive_score(text, model):
    numbers = naive_features(text, len(model.weight).bit_length() - 1)
    margin = (sum(model.weight[f] for f in numbers) / max(math.sqrt(sum(model.square[f] for f in numbers)), 1e-12) if numbers else 0.0) + model.bias
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def test_classifier_scores_against_brute_force(spark, data):
    texts = ["", "a", "Ab ab AB 12 12 12 x-y, é", "one one\ttwo two two", "HTTP 404!! a1B2"] + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    got = quality_classifier.features(texts)
    assert [g.tolist() for g in got] == [naive_features(t, quality_classifier.BITS) for t in texts]
    model = quality_classifier.learn(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    assert quality_classifier.scores(texts, model).tolist() == pytest.approx([naive_score(t, model) for t in texts], rel=1e-6)


def test_descent_reaches_the_least_loss():
    """The dual's solution: primal and dual objectives meet."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(120)]
    y, scale, cost = np.where(rng.random(120) < 0.5, 1.0, -1.0), rng.normal(size=40), np.full(120, 0.5)
    w, bias = quality_classifier.descend(rows, scale, y, cost, rounds=300)
    x = np.zeros((120, 41))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 40] = 1
    full = np.append(w, bias)
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(full) <= loss(full + rng.normal(scale=s, size=41)) + 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))
