"""Operator 1 [native]: line dedup by winnowing over line hashes.

A gram starts at a line and is the shortest run of lines from there that has min_lines lines or
min_words words. Grams with min_words words are fingerprints; of the other grams' hashes the
minima of all windows of so many neighbours are (the last of equal ones). So every repeated run of
min_words words, or of min_lines + window - 1 lines, holds a fingerprint wherever it stands.

Places are joined to earlier ones: within a document each place of a fingerprint to the one before
it, and a document's first and last place to the first of all, by document and line, if that is in
another document. Each such match is extended both ways to the first lines that differ, and the run's
later copy is deleted. Documents come in the order of (doc_id, hash of the text). A deleted line
always has an equal one at an earlier place, so the first copy of every line stays. A match is extended by
doubling and halving steps, and no further than to the neighbouring match at the same distance, which goes on from there: so
the work grows with the lines of the matched runs, whether they repeat at one distance or at many.

Only DataFrame functions are used. The text is read once for the hashes and once to rewrite it,
and is shuffled once; in between there are arrays of numbers. A fingerprint's places are counted
with partial sums before the shuffle, and no pair of places is made but those named.

Defined cases: a null text stays null and has no lines; an empty one has one line without words;
rows with the same doc_id and text are one document and are treated alike; rows with a null doc_id
are kept unchanged; columns other than doc_id and text are passed on; an empty table gives none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuseline.llm.common import WORD, stored

MIN_LINES, MIN_WORDS, WINDOW = 3, 50, 2


def hash60(c: Column) -> Column:
    """60 bits of the MD5 sum, which SQL engines have alike."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once for each row, also where use has it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lines (hashes) and words (word counts) of each different document."""
    text = F.col("text")
    return docs.filter("doc_id is not null and text is not null").select(
        "doc_id",
        hash60(text).alias("text_hash"),
        F.transform(_lines(text), hash60).alias("lines"),
        F.transform(_lines(text), lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
    )


def fingerprints(arrays: DataFrame, min_lines: int, min_words: int, window: int) -> DataFrame:
    """doc_id, text_hash, gram (hash), at (line), before (the document's last place of the gram before
    that, or null) and last (whether it has none after it) of each chosen gram."""

    def gram(i: Column) -> Column:
        """(hash or null, whether it has the words, line) of the gram from line i, counted from 0."""
        out = F.when(F.lit(False), F.lit(None))
        count = F.lit(0)
        for n in range(1, min_lines + 1):
            count = count + F.get("words", i + (n - 1))
            name = F.concat_ws(",", F.slice("lines", i + 1, n).cast("array<string>"))
            enough = count >= min_words
            out = out.when(enough if n < min_lines else i + n <= F.size("lines"), F.struct(hash60(name).alias("gram"), (-i).alias("back"), F.coalesce(enough, F.lit(False)).alias("long")))
        return out

    def minima(short: Column) -> Column:
        """The least of each window, of equal ones the last."""
        starts = F.greatest(F.lit(1), F.size(short) - (window - 1))
        near = lambda i: F.sequence(F.greatest(F.lit(1), i + (2 - window)), F.least(i + 1, starts))
        return F.filter(short, lambda g, i: F.exists(near(i), lambda s: F.array_min(F.slice(short, s, window))["back"] == g["back"]))

    def linked(chosen: Column) -> Column:
        """chosen by gram and line, each with its neighbours of the same gram."""
        same = lambda g, i: F.get(chosen, i)["gram"] == g["gram"]
        return F.transform(
            chosen, lambda g, i: F.struct(g["gram"], g["at"], F.when(same(g, i - 1), F.get(chosen, i - 1)["at"]).alias("before"), (~F.coalesce(same(g, i + 1), F.lit(False))).alias("last"))
        )

    grams = F.filter(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), gram), lambda g: g.isNotNull())
    short = lambda gs: _let(F.filter(gs, lambda g: ~g["long"]), minima)
    chosen = _let(grams, lambda gs: F.transform(F.concat(F.filter(gs, lambda g: g["long"]), short(gs)), lambda g: F.struct(g["gram"], (-g["back"]).alias("at"))))
    return arrays.select("doc_id", "text_hash", F.explode(_let(F.array_sort(chosen), linked)).alias("p")).select("doc_id", "text_hash", "p.*")


def aligned(seeds: DataFrame) -> DataFrame:
    """doc_id, text_hash, first_id, first_hash and found, an array of (shift, at), for each document and
    document with earlier places of its fingerprints; it may be the same."""
    ends = seeds.filter("before IS NULL OR last")
    first = ends.filter("before IS NULL").groupBy("gram").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash"))
    far = ends.join(first, "gram").filter(other)
    far = far.select("doc_id", "text_hash", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), (F.col("at") - F.col("first.at")).alias("shift"), "at")
    own = seeds.filter("before IS NOT NULL").select("doc_id", "text_hash", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), (F.col("at") - F.col("before")).alias("shift"), "at")
    return far.unionByName(own).groupBy("doc_id", "text_hash", "first_id", "first_hash").agg(F.collect_list(F.struct("shift", "at")).alias("found"))


def extended(found: Column, f: Column, i: Column) -> Column:
    """(lo, hi) of the equal lines round the match f, the i-th of found (shift, at), which are in order; no further than to the
    matches before and behind it of the same shift."""
    at, shift = f["at"], f["shift"]
    same = lambda k: F.when(F.get(found, k)["shift"] == shift, F.get(found, k)["at"])
    ahead = F.coalesce(same(i + 1) - at, F.size("lines") - 1 - at)
    back = F.coalesce(at - same(i - 1), F.least(at, at - shift))
    equal = lambda start, n: F.slice("lines", start + 1, n) == F.slice("first_lines", start - shift + 1, n)
    return F.struct((at - _reach(back, lambda e, n: equal(at - e - n, n))).alias("lo"), (at + _reach(ahead, lambda e, n: equal(at + 1 + e, n))).alias("hi"))


def _reach(most: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """The greatest number of lines, at most most, that are equal; equal(e, n) tells it of the n lines behind the first e.
    Steps of 1, 2, 4, ... lines as long as these are equal, then ever shorter ones."""
    top = F.ceil(F.log2(most + 1)).cast("int")
    n = lambda k: F.call_function("shiftleft", F.lit(1), k)
    step = lambda e, k: (e + n(k) <= most) & equal(e, n(k))
    # as long as all steps went on, 2**k - 1 lines are known before step k
    up = F.aggregate(F.sequence(F.lit(0), top), F.lit(0), lambda e, k: F.when((e == n(k) - 1) & step(e, k), e + n(k)).otherwise(e))
    down = lambda e0: F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), e0, lambda e, k: F.when((n(k) <= e + 1) & step(e, k), e + n(k)).otherwise(e))
    return F.when(most <= 0, 0).otherwise(_let(up, down))


def repeated_lines(arrays: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash and gone, the runs (lo, hi) of lines to delete in order, for documents with any.
    arrays: line_arrays() without repeated rows, stored, so that both sides of the joins below are
    dealt anew and a document that many others copy is split."""
    pairs = aligned(stored(fingerprints(arrays, min_lines, min_words, window), "fingerprints"))
    source = arrays.select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.col("lines").alias("first_lines"))
    both = pairs.join(source, ["first_id", "first_hash"]).join(arrays.select("doc_id", "text_hash", "lines"), ["doc_id", "text_hash"])
    runs = _let(F.array_sort("found"), lambda found: F.transform(found, lambda f, i: extended(found, f, i)))
    hit = both.select("doc_id", "text_hash", F.explode(runs).alias("r")).select("doc_id", "text_hash", "r.*").distinct()
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(ahead.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    hit = hit.withColumn("fresh", fresh.cast("int"))
    hit = hit.withColumn("part", F.sum("fresh").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    hit = hit.groupBy("doc_id", "text_hash", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """row (docs' columns as they were), text less the later copies of repeated runs, n_lines and
    n_removed."""
    found = repeated_lines(stored(line_arrays(docs).dropDuplicates(["doc_id", "text_hash"]), "lines"), min_lines, min_words, window).withColumnRenamed("doc_id", "id")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), "text", hash60(F.col("text")).alias("own_hash"))
    d = d.join(found.hint("shuffle_hash"), (F.col("own_id") == F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")

    def left(lines: Column) -> Column:
        """The lines between the runs that go."""
        gone = F.col("gone")
        start = lambda i: F.when(i > 0, F.get(gone, i - 1)["hi"] + 1).otherwise(0)
        stop = lambda i: F.coalesce(F.get(gone, i)["lo"], F.size(lines))
        return F.concat_ws("\n", F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, F.greatest(stop(i) - start(i), F.lit(0))))))

    n_gone = F.aggregate("gone", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"] + 1)
    return d.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(_lines(F.col("text")), left)).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(n_gone).alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """docs with text less the later copies of repeated runs, and n_lines and n_removed (long),
    which replace columns of these names."""
    out = deduplicated(docs, min_lines, min_words, window)
    new = ("text", "n_lines", "n_removed")
    return out.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c == "text" or c not in new], "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


#: {docs} stands for the table: another stage's SQL can be put there.
SQL = r"""
WITH src AS (SELECT DISTINCT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_hash FROM {docs} AS t
    WHERE doc_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT doc_id, text_hash, string_split(text, chr(10)) AS xs FROM src),
line AS (SELECT doc_id, text_hash, unnest(range(len(xs))) AS pos, unnest(xs) AS x FROM parts),
num AS (SELECT doc_id, text_hash, pos, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM line),
ahead AS (SELECT *, lead(h, 1) OVER o AS h1, lead(h, 2) OVER o AS h2, lead(w, 1) OVER o AS w1
    , lead(w, 2) OVER o AS w2 FROM num WINDOW o AS (PARTITION BY doc_id, text_hash ORDER BY pos)),
gram AS (SELECT doc_id, text_hash, pos,
    CASE WHEN w >= 50 THEN h::VARCHAR WHEN w + w1 >= 50 THEN h || ',' || h1 WHEN h2 IS NOT NULL THEN h || ',' || h1 || ',' || h2 END AS name,
    coalesce(w >= 50 OR w + w1 >= 50 OR w + w1 + w2 >= 50, false) AS long FROM ahead),
g AS (SELECT doc_id, text_hash, pos, long, ('0x' || substr(md5(name), 1, 15))::BIGINT AS gram FROM gram WHERE name IS NOT NULL),
near AS (SELECT *, lead(gram) OVER o AS later, lag(gram) OVER o AS before, count(*) OVER (PARTITION BY doc_id, text_hash) AS n
    FROM g WHERE NOT long WINDOW o AS (PARTITION BY doc_id, text_hash ORDER BY pos)),
seed AS (SELECT doc_id, text_hash, pos, gram FROM g WHERE long
    UNION ALL SELECT doc_id, text_hash, pos, gram FROM near WHERE n = 1 OR gram < later OR gram <= before),
occ AS (SELECT *, lag(pos) OVER o AS before, lead(pos) OVER o AS after FROM seed WINDOW o AS (PARTITION BY doc_id, text_hash, gram ORDER BY pos)),
fst AS (SELECT gram, min({{'d': doc_id, 't': text_hash, 'p': pos}}) AS f FROM occ WHERE before IS NULL GROUP BY gram HAVING count(*) > 1),
al AS (SELECT doc_id, text_hash, pos, doc_id AS fd, text_hash AS ft, pos - before AS shift FROM occ WHERE before IS NOT NULL
    UNION ALL SELECT s.doc_id, s.text_hash, s.pos, f.d, f.t, s.pos - f.p FROM occ s JOIN fst USING (gram)
    WHERE (before IS NULL OR after IS NULL) AND NOT (s.doc_id = f.d AND s.text_hash = f.t)),
pair AS (SELECT DISTINCT doc_id, text_hash, fd, ft, shift FROM al),
same AS (SELECT p.*, a.pos, a.pos - row_number() OVER (PARTITION BY p.doc_id, p.text_hash, fd, ft, shift ORDER BY a.pos) AS isle
    FROM pair p JOIN num a ON a.doc_id = p.doc_id AND a.text_hash = p.text_hash
    JOIN num b ON b.doc_id = p.fd AND b.text_hash = p.ft AND b.pos = a.pos - p.shift AND b.h = a.h),
hit AS (SELECT DISTINCT doc_id, text_hash, fd, ft, shift, isle FROM same JOIN al USING (doc_id, text_hash, fd, ft, shift, pos)),
gone AS (SELECT DISTINCT doc_id, text_hash, pos FROM same JOIN hit USING (doc_id, text_hash, fd, ft, shift, isle)),
kept AS (SELECT doc_id, text_hash, string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_removed
    FROM line LEFT JOIN gone USING (doc_id, text_hash, pos) GROUP BY 1, 2)
"""
ORACLE_SQL = {
    "op1_line_dedup": SQL.format(docs="documents")
    + """SELECT t.doc_id, CASE WHEN k.doc_id IS NULL THEN t.text ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, CASE WHEN t.text IS NULL THEN 0 ELSE len(string_split(t.text, chr(10))) END) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents t LEFT JOIN kept k ON t.doc_id = k.doc_id AND ('0x' || substr(md5(t.text), 1, 15))::BIGINT = k.text_hash"""
}
