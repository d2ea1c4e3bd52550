"""Operator 9: mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it is taken on average. Of all rates between 0 and
the limit whose tokens meet each source's target, those of least relative entropy against a rate
of 1 are rate = min(limit, exp(l * x)) with x the document's size in units of its source's mean
and one number l for each source: the tilt. The tilts solve the convex dual. Newton's method
finds them: each iteration is one distributed aggregation of the gradient and the curvature of all
sources over (source, size, number of documents), with the steps kept inside a bracket.

Rates are then rounded to whole copies, up or down, within bounded groups of a source from the
largest document to the smallest: each takes over the words that the larger ones owe or have taken
too many, so a group's error is about half of a small document. Rows with the same doc_id, text and
source are one entry with a number there, and share its copies evenly.

Only figures for each source (its total, its target, its tilt) come to the driver; the sources
of a mix are given by the user and few. Defined cases: a null text has size 0; documents of size 0
are taken as often as rates say, which adds no words; a null source is a source, and the last;
rows that repeat a doc_id are rounded each, those that repeat its text as well together (which of them
has one copy more is left open); an empty table gives no rows; other columns pass."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuseline.llm.common import WORD, stored

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Each source's target. Sources come by code point, null last, and weigh weights in turn.
    What a source can't take, as it would pass limit times its size, the others share."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        unit = total / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > limit * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = limit * sizes[s]
            total -= out[s]
        total, open_ = max(total, 0.0), [s for s in open_ if s not in over]
    return out


def _literal(values: dict[str | None, float], source: Column) -> Column:
    """values[source] as an expression; a null source has its own."""
    named = [x for s, v in values.items() if s is not None for x in (F.lit(s), F.lit(float(v)))]
    known = F.try_element_at(F.create_map(*named), source) if named else F.lit(None).cast("double")
    return F.when(source.isNull(), F.lit(float(values.get(None, 0.0)))).otherwise(known)


def tilts(histogram: DataFrame, goal: dict, total: dict, docs: dict, limit: float, tolerance: float = 1e-9, rounds: int = 60) -> dict:
    """Each source's tilt for histogram (source, size, n). A source whose target is all that the
    limit allows has an infinite one; one with target 0 minus infinity."""
    mean = {s: total[s] / docs[s] for s in total if docs[s]}
    tilt, low, high = {}, {}, {}
    for s in goal:
        if not total[s]:
            tilt[s] = 0.0
        elif goal[s] >= limit * total[s] * (1 - 1e-12):
            tilt[s] = math.inf
        elif goal[s] <= 0:
            tilt[s] = -math.inf
        else:
            tilt[s] = low[s] = high[s] = 0.0
            low[s], high[s] = -math.inf, math.inf
    active = set(low)
    for _ in range(rounds):
        if not active:
            break
        now = {s: tilt[s] for s in active}
        x = F.col("size") / _literal({s: mean[s] for s in active}, F.col("source"))
        keep = F.col("source").isin([s for s in active if s is not None])
        keep = F.coalesce(keep, F.lit(None in active)) if None in active else keep
        power = F.least(_literal(now, F.col("source")) * x, F.lit(math.log(limit)))
        words = F.col("n") * F.col("size") * F.exp(power)
        slope = F.when(power < math.log(limit), words * x).otherwise(0.0)
        got = histogram.filter(keep).groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")).collect()
        for r in got:
            s, gap = r["source"], goal[r["source"]] - r["words"]
            if abs(gap) <= tolerance * goal[s]:
                active.discard(s)
                continue
            if gap > 0:
                low[s] = tilt[s]
            else:
                high[s] = tilt[s]
            step = tilt[s] + gap / r["slope"] if r["slope"] > 0 else math.nan
            if not (low[s] < step < high[s]) or abs(step - tilt[s]) > 4:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = tilt[s] + math.copysign(max(1.0, abs(tilt[s])), gap)
                else:
                    step = (low[s] + high[s]) / 2
            if step == tilt[s]:
                active.discard(s)
            tilt[s] = step
    return {s: float(f"{v:.11g}") for s, v in tilt.items()}  # sums in another order give the same


def round_rates(sizes: list[int], rates: list[float], counts: list[int] | None = None, limit: float = LIMIT) -> list[int]:
    """Whole copies of counts equal documents each (one if not given), each rate rounded up or down, so
    that the words that are left over or lacking so far stay few; sizes fall. What is left at the end
    moves the documents of the most fitting size by one copy, a few at most."""
    owed, out = 0.0, []
    counts = counts or [1] * len(sizes)
    for size, rate, n in zip(sizes, rates, counts, strict=True):
        low, high = math.floor(rate + 1e-9) * n, math.ceil(rate - 1e-9) * n
        wanted = rate * n + owed / size if size else rate * n
        copies = min(max(math.floor(wanted + 0.5), low), high)
        owed += (rate * n - copies) * size
        out.append(copies)
    for _ in range(3):
        step = 1 if owed > 0 else -1
        free = [i for i, c in enumerate(out) if 0 < sizes[i] < 2 * abs(owed) - 1 and 0 <= c + step <= limit * counts[i]]
        if not free:
            break
        best = min(free, key=lambda i: abs(abs(owed) - sizes[i]))
        out[best] += step
        owed -= step * sizes[best]
    return out


_ENTRY = ["source", "doc_id", "_size", "_hash"]


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with number, from 1 among those of an entry; counted in each stored partition first, so
    that no task takes an entry's rows whole."""
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    inner = F.row_number().over(Window.partitionBy(*_ENTRY, "_part").orderBy("_row"))
    per = rows.groupBy(*_ENTRY, "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_ENTRY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(c).alias(f"{c}_2") for c in (*_ENTRY, "_part")], before.alias("before"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in (*_ENTRY, "_part")]
    return rows.withColumn("inner", inner).join(per, on).withColumn("number", F.col("inner") + F.col("before"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, group: int = 4096, with_docs: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of each row of docs
    (doc_id, text, source); with_docs: docs itself with each row as often as it has copies."""
    row = [F.struct(*docs.columns).alias("whole")] if with_docs else []
    rows = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("_size"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"), *row), "sized")
    entries = stored(rows.groupBy(*_ENTRY).agg(F.count("*").alias("_n")), "entries")
    histogram = stored(entries.groupBy("source", F.col("_size").alias("size")).agg(F.sum("_n").alias("n")), "histogram")
    per = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect()}
    total, n_docs = {s: r["words"] for s, r in per.items()}, {s: r["docs"] for s, r in per.items()}
    goal = targets(total, weights, share, limit)
    tilt = tilts(histogram, goal, total, n_docs, limit)
    capped = {s: min(max(v, -1e6), 1e6) for s, v in tilt.items()}
    mean = {s: max(total[s] / n_docs[s], 1e-300) for s in per}
    source, size = F.col("source"), F.col("_size")
    power = F.least(_literal(capped, source) * size / _literal(mean, source), F.lit(math.log(limit)))
    rate = F.when(_literal({s: float(math.isinf(v) and v > 0) for s, v in tilt.items()}, source) > 0, F.lit(limit)).otherwise(F.exp(power))
    groups = {s: float(max(1, -(-n_docs[s] // group))) for s in per}
    part = F.pmod(F.xxhash64("doc_id", "_hash"), _literal(groups, source).cast("long"))
    rated = entries.withColumns({"rate": rate, "_group": part})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "doc_id", "_hash"], ascending=[False, True, True], kind="stable")
        return pdf.assign(copies=round_rates(pdf["_size"].tolist(), pdf["rate"].tolist(), pdf["_n"].tolist(), limit)).drop(columns="_group")

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rated.drop("_group").schema.fields)
    done = stored(rated.groupBy("source", "_group").applyInPandas(whole, shape + ", copies long"), "copies")
    each = done.select(*[F.col(c).alias(f"{c}_1") for c in _ENTRY], "rate", F.expr("copies div _n").alias("least"), F.expr("copies % _n").alias("more"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_1")) for c in _ENTRY]
    out = rows.join(each.filter("more = 0"), on).withColumn("copies", F.col("least"))
    uneven = each.filter("more > 0")
    if not uneven.isEmpty():  # only rows that repeat share copies unevenly
        shared = _numbered(rows.join(uneven, on)).withColumn("copies", F.col("least") + (F.col("number") <= F.col("more")).cast("long"))
        out = out.unionByName(shared.select(out.columns))
    if with_docs:
        again = F.explode(F.array_repeat("whole", F.col("copies").cast("int")))
        return out.filter("copies > 0").select(again.alias("whole")).select("whole.*")
    return out.select(
        "doc_id", "source", F.col("_size").alias("size"), _literal({s: float(v) for s, v in total.items()}, source).cast("long").alias("source_size"),
        _literal(goal, source).alias("target"), "rate", "copies", (F.col("copies") * size).alias("taken"),
    )


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs)
