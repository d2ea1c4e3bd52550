"""Operator 10: a quality classifier of naive Bayes support vectors.

A text's features are indicators of n-grams, hashed to a fixed number of places: words and pairs of
words, single to triple shapes of words (letters, digits and case without their number, other
characters as they are), and words that repeat the one or the two before. Each indicator is scaled by the
log ratio of its smoothed counts in the two classes, rows are scaled to length 1, and a linear
model with hinge loss is fitted by dual coordinate descent. A logistic curve, fitted to a part of
the learning rows that the model was not fitted to, turns margins into scores.

It learns from at most max_rows labelled rows, the first by a hash of doc_id; counts, descent
and curve are fitted to these in one task, which holds their features only. Scoring reads every
whole text where it lies, without a shuffle.

Defined cases: a null text counts as empty, and an empty one has no features and the model's
score for none; rows that repeat a doc_id are scored each; rows without doc_id aren't learned from
and not held out; labels other than 0 and 1 aren't learned from; with labels of one class or none
all scores are that class or 0.5; an empty table gives no rows; other columns pass or are ignored."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import chunked, hash_words, joined, mix64, pieces, text_or_empty

BITS, MAX_ROWS, THRESHOLD = 18, 8_000, 0.7
ROUNDS, PENALTY, SMOOTHING = 6, 1.0, 1.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """score(text) = 1 / (1 + exp(-(slope * margin + shift))), margin the sum of weight over the
    text's features by the root of the sum of square, plus bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float


def _shape_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    return out


_SHAPE = _shape_table()


def _shapes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """joined() texts with each run of letters of a case or digits made one character."""
    out = _SHAPE[buf]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | ~np.isin(out[1:], np.frombuffer(b"Aa0", np.uint8))
    return out[keep], np.cumsum(keep)[ends - 1]


def features(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """The sorted numbers of each text's features."""
    out: list[np.ndarray] = []
    cut = np.uint64(64 - bits)
    for _, part in chunked(texts):
        buf, ends = joined(part)
        words, bounds = hash_words(buf, ends)
        shapes, _ = hash_words(*_shapes(buf, ends))
        text = np.repeat(np.arange(len(part)), np.diff(bounds))

        def grams(of: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
            h = mix64(of + np.uint64(kind))
            for k in range(1, n):
                h = mix64(h[:-1] * _ODD + of[k:]) if len(h) else h
            whole = text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)
            return text[: len(h)][whole], h[whole]

        streams = [grams(words, 1, 1), grams(words, 2, 2), grams(shapes, 1, 3), grams(shapes, 2, 4), grams(shapes, 3, 5)]
        same = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) if len(words) else np.zeros(0, int)
        again = same[1:][same[1:] == same[:-1] + 1]
        streams += [(text[at], np.full(len(at), mix64(np.array([kind], np.uint64))[0])) for at, kind in ((same, 7), (again, 8))]
        key = np.concatenate([(t.astype(np.int64) << bits) | (h >> cut).astype(np.int64) for t, h in streams])
        key = np.unique(key)
        at = np.searchsorted(key, np.arange(len(part) + 1, dtype=np.int64) << bits)
        number = (key & ((1 << bits) - 1)).astype(np.int32)
        out += [number[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) of least |w|^2/2 + sum cost * max(0, 1 - y * (w.x + b)) for x the scaled
    rows of length 1 with a constant 1 added, by coordinate descent in the dual."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    values = [v / (np.sqrt((v * v).sum()) or 1.0) for v in values]
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of greatest likelihood with a weak pull to (1, 0); y is 0 or 1."""
    ab, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        gradient = x.T @ (p - target) + 1e-3 * (ab - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        ab = ab - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def margins(rows: list[np.ndarray], weight: np.ndarray, square: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weight[r].sum() / max(np.sqrt(square[r].sum()), 1e-12) if len(r) else 0.0 for r in rows]) + bias


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS) -> Model:
    """The model of rows, features() of texts, and their labels."""
    size, y = 1 << bits, np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0 if not len(y) else (10.0 if y[0] else -10.0))
    fitted = np.arange(len(rows)) % 5 != 4
    if not (set(y[fitted]) == set(y[~fitted]) == {0, 1}):
        fitted[:] = True
    count = [np.full(size, SMOOTHING), np.full(size, SMOOTHING)]
    for i in np.flatnonzero(fitted):
        count[y[i]][rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    share = [max(1, (y[fitted] == c).sum()) for c in (0, 1)]
    part = [rows[i] for i in np.flatnonzero(fitted)]
    cost = PENALTY * np.array([len(part) / (2 * share[c]) for c in y[fitted]])
    w, bias = descend(part, ratio, np.where(y[fitted] == 1, 1.0, -1.0), cost, ROUNDS)
    weight, square = w * ratio, ratio * ratio
    check = ~fitted if not fitted.all() else fitted
    slope, shift = logistic(margins([rows[i] for i in np.flatnonzero(check)], weight, square, bias), y[check])
    return Model(weight, square, bias, slope, shift)


def scores(texts: list[str], model: Model) -> np.ndarray:
    out = model.slope * margins(features(texts, len(model.weight).bit_length() - 1), model.weight, model.square, model.bias) + model.shift
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """The model of docs (doc_id, text) that labels (doc_id, quality) mark and that aren't held out."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marked), "doc_id")  # at most max_rows

    @F.arrow_udf("array<int>")
    def numbers(text: pa.Array) -> pa.Array:
        return pa.array([r for _, part in pieces(text) for r in features(part, bits)], pa.list_(pa.int32()))

    rows = rows.select("doc_id", "quality", numbers("text").alias("row"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("row")).limit(max_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        m = fit([np.asarray(r, dtype=np.int32) for r in pdf["row"]], pdf["quality"].astype(int).tolist(), bits)
        return pd.DataFrame({"weight": [m.weight.astype("<f4").tobytes()], "square": [m.square.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    one = rows.select("doc_id", "quality", "row", F.xxhash64("doc_id", "row").alias("order"), F.lit(0).alias("all"))
    got = one.groupBy("all").applyInPandas(run, "weight binary, square binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([], [], bits)
    r = got[0]
    return Model(np.frombuffer(r["weight"], "<f4").astype(float), np.frombuffer(r["square"], "<f4").astype(float), r["bias"], r["slope"], r["shift"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(part, shared.value) for _, part in pieces(text))]))

    return docs.withColumn("score", score(text_or_empty()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, labels, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
