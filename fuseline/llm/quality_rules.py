"""Operator 7: quality rules whose thresholds follow each language and source.

Counts are taken of every whole text; from them come ratios in whole units (thousandths, or
tenths of a character for the mean word length). A sketch of a ratio is the number of documents in
each bucket: units below 64 have their own, larger ones share those that agree in their first
six binary digits. So a quantile is at most 1/32 too small, a sketch has at most some 200 buckets for a ratio in
thousandths and 32 more for each doubling, and sketches merge by adding, in any order and with
the same result. They are made for each language and source, for each language and for all.

Only documents within the base limits are counted there, so junk that these reject shapes no tail. A group's
fence is its median and a distance beyond it, a multiple of a tail quantile's, and at least a small floor:

    upper = median + max(spread * (tail quantile - median), floor)
    lower = median - max(spread * (median - opposite quantile), floor)   (mean word length only)

The tail quantile of symbols and word length is the upper quartile, which up to a quarter of bad documents
can't move far. Few documents tell little of a tail, and bad ones may fill one group's: so a
group's distance counts up to LIMIT times its parent's, and median and distances are the means of the group's own, weighing as many
documents as it has, and its parent's, weighing PRIOR documents; a language's parent is the whole. No share's fence is above
100 %.

Defined cases: a null text has no words; null languages and sources are groups of their own; rows
that repeat are counted each; texts below the base limits fail whatever the fences; an empty
table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuseline.llm.common import WORD_RE, chunked, mix64, pieces, stored, text_or_empty, word_hashes

#: Fixed: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that a parent's fence weighs.
PRIOR = 200
#: Times its parent's distance that a group's may count.
LIMIT = 8
#: Ratio: (percent of the tail quantile, spread, floor in units, whether there is a lower fence).
FENCES = {"symbols": (75, 4, 20, False), "dup_lines": (90, 3, 400, False), "repeats": (90, 4, 300, False), "word_length": (75, 6, 10, True)}
#: Units of a whole, where a ratio is a share of one.
WHOLE = {"symbols": 1000, "dup_lines": 1000, "repeats": 1000}


def repeat_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in 3-word windows that the text has twice or more) of each text."""
    words, repeats = [], []
    for _, part in chunked(texts):
        hashes, bounds = word_hashes(part)
        counts = np.diff(bounds)
        text = np.repeat(np.arange(len(part)), counts)
        covered = np.zeros(len(hashes) + 1, dtype=np.int64)
        if len(hashes) >= 3:
            key = mix64(hashes[:-2] + text[:-2].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1])
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashes[2:])
            inside = np.flatnonzero(text[:-2] == text[2:])
            _, at, n = np.unique(key[inside], return_inverse=True, return_counts=True)
            starts = inside[n[at] > 1]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + 3, -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
        words.append(counts)
        repeats.append(hit[bounds[1:]] - hit[bounds[:-1]])
    return (np.concatenate(words), np.concatenate(repeats)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row of docs (doc_id, text, lang, source)."""

    @F.arrow_udf("n_words long, n_repeat_words long")
    def windows(text: pa.Array) -> pa.Array:
        found = [repeat_words(part) for _, part in pieces(text)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]), pa.int64()) for k in (0, 1)], names=["n_words", "n_repeat_words"])

    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE.pattern))
    got = docs.select(
        "doc_id", "lang", "source", windows(text).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return got.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")


def _units() -> dict[str, Column]:
    def ratio(a: str, b: str, by: int) -> Column:
        return F.floor(F.when(F.col(b) > 0, F.col(a) * by / F.col(b)).otherwise(F.lit(0.0))).cast("long")

    return {"symbols": ratio("n_symbols", "word_chars", 1000), "dup_lines": ratio("n_dup_lines", "n_lines", 1000), "repeats": ratio("n_repeat_words", "n_words", 1000), "word_length": ratio("word_chars", "n_words", 10)}


def bucket(unit: Column) -> Column:
    """The least unit of unit's bucket."""
    return unit - F.pmod(unit, F.pow(F.lit(2), F.greatest(F.length(F.bin(unit)) - 6, F.lit(0))).cast("long"))


def sketches(measured: DataFrame) -> DataFrame:
    """level, lang, source, ratio, unit, n: level 2 for each language and source, 1 for each
    language, 0 for all. measured has the ratios as columns."""
    long = measured.select("lang", "source", F.explode(F.create_map(*[x for m in FENCES for x in (F.lit(m), bucket(F.col(m)))])).alias("ratio", "unit"))
    fine = long.groupBy("lang", "source", "ratio", "unit").agg(F.count("*").alias("n"))
    middle = fine.groupBy("lang", "ratio", "unit").agg(F.sum("n").alias("n"))
    coarse = middle.groupBy("ratio", "unit").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        fine.select(F.lit(2).alias("level"), "lang", "source", "ratio", "unit", "n")
        .unionByName(middle.select(F.lit(1).alias("level"), "lang", none.alias("source"), "ratio", "unit", "n"))
        .unionByName(coarse.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "ratio", "unit", "n"))
    )


def own_fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source, docs and a lower and upper fence for each ratio, by the group's own sketch."""
    group = Window.partitionBy("level", "lang", "source", "ratio")
    upto = F.sum("n").over(group.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    cum = sketch.withColumns({"upto": upto, "docs": F.sum("n").over(group)})
    tail = F.lit(None).cast("long")
    for ratio, (percent, *_) in FENCES.items():
        tail = F.when(F.col("ratio") == ratio, percent).otherwise(tail)
    cum = cum.withColumn("tail", tail)
    per = cum.groupBy("level", "lang", "source", "ratio")
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * percent, F.col("unit")))
    q = per.agg(F.first("docs").alias("docs"), at(100 - F.col("tail")).alias("low"), at(50).alias("mid"), at(F.col("tail")).alias("high"))
    out = []
    for ratio, (_, spread, floor, _) in FENCES.items():
        mine = lambda x, r=ratio: F.max(F.when(F.col("ratio") == r, x)).cast("double")
        out.append(mine(F.col("mid")).alias(f"{ratio}_mid"))
        out.append(mine(F.greatest((F.col("high") - F.col("mid")) * spread, F.lit(floor))).alias(f"{ratio}_up"))
        out.append(mine(F.greatest((F.col("mid") - F.col("low")) * spread, F.lit(floor))).alias(f"{ratio}_down"))
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *out)


def fences(sketch: DataFrame, prior: int = PRIOR, limit: float = LIMIT) -> DataFrame:
    """lang, source and each ratio's upper and lower fence; all are drawn to those of the language, and these to those of all."""
    own = stored(own_fences(sketch), "own_fences")
    parts = [f"{r}_{k}" for r in FENCES for k in ("mid", "up", "down")]

    def drawn(part: DataFrame, parent: DataFrame, on) -> DataFrame:
        def mean(c: str) -> Column:
            mine = F.col(f"p.{c}") if c.endswith("_mid") else F.least(F.col(f"p.{c}"), F.col(f"q.{c}") * limit)
            return ((mine * F.col("p.docs") + F.col(f"q.{c}") * prior) / (F.col("p.docs") + prior)).alias(c)

        both = part.alias("p").join(parent.alias("q"), on, "left")
        return both.select("p.lang", "p.source", *map(mean, parts))

    whole, languages, sources = (own.filter(F.col("level") == k) for k in (0, 1, 2))
    languages = drawn(languages, F.broadcast(whole), F.lit(True))  # one row
    found = drawn(sources, languages, F.col("p.lang").eqNullSafe(F.col("q.lang")))
    upper = {r: F.col(f"{r}_mid") + F.col(f"{r}_up") for r in FENCES}
    upper |= {r: F.least(upper[r], F.lit(float(n))) for r, n in WHOLE.items()}
    return found.select("lang", "source", *[upper[r].alias(f"{r}_upper") for r in FENCES], *[(F.col(f"{r}_mid") - F.col(f"{r}_down")).alias(f"{r}_lower") for r in FENCES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def apply_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of docs."""
    measured = stored(counts(docs).withColumns(_units()), "counts")
    fence = stored(fences(sketches(measured.filter(~base_failed())), prior), "fences").alias("f")
    m = measured.alias("m")
    out = m.join(fence, F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    verdict = F.lit(True)
    for ratio, (*_, lower) in FENCES.items():
        verdict &= F.col(f"m.{ratio}") <= F.col(f"f.{ratio}_upper")
        if lower:
            verdict &= F.col(f"m.{ratio}") >= F.col(f"f.{ratio}_lower")
    failed = base_failed()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


ORACLE_SQL = {
    "op7_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
win AS (SELECT r, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM word GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT t.r, doc_id, lang, source, coalesce(wc.n, 0) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines FROM t LEFT JOIN wc USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
a AS (SELECT r, lang, source, 'symbols' AS ratio, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS unit FROM m
    UNION ALL SELECT r, lang, source, 'dup_lines', CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END FROM m
    UNION ALL SELECT r, lang, source, 'repeats', CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END FROM m
    UNION ALL SELECT r, lang, source, 'word_length', CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END FROM m),
k AS (SELECT a.r, a.lang, a.source, ratio, unit - unit % (1::BIGINT << greatest(length(bin(unit)) - 6, 0)) AS unit FROM a JOIN m USING (r) WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
s AS (SELECT 2 AS level, lang, source, ratio, unit, count(*) AS n FROM k GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, ratio, unit, count(*) FROM k GROUP BY ALL
    UNION ALL SELECT 0, NULL, NULL, ratio, unit, count(*) FROM k GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY unit) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS docs,
    CASE WHEN ratio IN ('dup_lines', 'repeats') THEN 90 ELSE 75 END AS tail FROM s),
q AS (SELECT level, lang, source, ratio, max(docs) AS docs, min(unit) FILTER (100 * upto >= docs * (100 - tail)) AS low, min(unit) FILTER (100 * upto >= docs * 50) AS mid,
    min(unit) FILTER (100 * upto >= docs * tail) AS high FROM c GROUP BY ALL),
rule AS (SELECT * FROM (VALUES ('symbols', 4, 20, 1000), ('dup_lines', 3, 400, 1000), ('repeats', 4, 300, 1000), ('word_length', 6, 10, NULL)) AS x(ratio, spread, floor, whole)),
f AS (SELECT level, lang, source, q.ratio, docs::DOUBLE AS docs, mid::DOUBLE AS mid, greatest((high - mid) * spread, floor)::DOUBLE AS up,
    greatest((mid - low) * spread, floor)::DOUBLE AS down, whole FROM q JOIN rule ON rule.ratio = q.ratio),
f1 AS (SELECT p.lang, p.ratio, (p.mid * p.docs + o.mid * 200) / (p.docs + 200) AS mid, (least(p.up, o.up * 8) * p.docs + o.up * 200) / (p.docs + 200) AS up,
    (least(p.down, o.down * 8) * p.docs + o.down * 200) / (p.docs + 200) AS down FROM f p JOIN f o ON p.level = 1 AND o.level = 0 AND p.ratio = o.ratio),
f3 AS (SELECT p.lang, p.source, p.ratio, p.whole, (p.mid * p.docs + o.mid * 200) / (p.docs + 200) AS mid, (least(p.up, o.up * 8) * p.docs + o.up * 200) / (p.docs + 200) AS up,
    (least(p.down, o.down * 8) * p.docs + o.down * 200) / (p.docs + 200) AS down FROM f p JOIN f1 o ON p.level = 2 AND p.ratio = o.ratio AND p.lang IS NOT DISTINCT FROM o.lang),
f2 AS (SELECT lang, source, ratio, CASE WHEN whole IS NULL THEN mid + up ELSE least(mid + up, whole) END AS hi, mid - down AS lo FROM f3),
v AS (SELECT a.r, bool_and(unit <= hi AND (unit >= lo OR a.ratio <> 'word_length')) AS good FROM a
    LEFT JOIN f2 ON f2.ratio = a.ratio AND f2.lang IS NOT DISTINCT FROM a.lang AND f2.source IS NOT DISTINCT FROM a.source GROUP BY a.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(good, FALSE) AND NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS kept FROM m JOIN v USING (r)
"""
}
