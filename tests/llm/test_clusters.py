"""Centroid clustering against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from fuseline.llm import centroid_clusters as cc


def brute(rows, k=8, rounds=10):
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), x in zip(kept, of, strict=True) if x == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    total = total if total < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sum(x for _, x, y in last if y == j), total, names[j]) for i, d, j in last), key=str)


def test_annulus_gives_the_nearest_and_compares_few():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-40, 40, (200, 64)) * rng.integers(1, 60, (200, 1))
    vectors = centroids[rng.integers(0, 200, 3000)] + rng.integers(-30, 30, (3000, 64))
    near, distance, n = cc.Annulus(centroids).nearest(vectors)
    every = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert near.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
    assert n < 0.5 * every.size


@pytest.mark.parametrize("scale", [1, 1 << 16, 1 << 25])
def test_ties_on_the_border(scale):
    """Equal centroids, mirrored ones, and norms that tie with the bound: the smaller number wins."""
    axis = np.eye(64, dtype=np.int64) * scale
    centroids = np.concatenate([-axis[:4], axis[:4], axis[:4], np.zeros((1, 64), np.int64)])
    vectors = np.concatenate([axis[:6], -axis[:6], np.zeros((1, 64), np.int64), axis[:1] // 2, axis[:1] + axis[1:2], 3 * axis[:2]])
    near, distance, _ = cc.Annulus(centroids).nearest(vectors)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in vectors]
    assert near.tolist() == [e.index(min(e)) for e in every] and distance.tolist() == [min(e) for e in every]


def test_query_against_loops(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, cc.op12_annulus_clusters(spark, data).collect()), key=str) == brute(rows)


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(7, rows[7][1])] * 30 + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [float("inf")] * 64), (106, [1e30] * 64), (107, [1.0] * 65)]
    return rows, bad


def test_cases(spark):
    rows, bad = odd_rows()
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS v", "3 AS distance", "4 AS n")
    for x in (df, df.repartition(9)):
        assert sorted(map(tuple, cc.centroid_clusters(x).collect()), key=str) == brute(rows)
    assert cc.centroid_clusters(df.filter("false")).count() == 0 and cc.centroid_clusters(df.filter("vec_id > 99")).count() == 0
    few = cc.centroid_clusters(df.filter("vec_id in (1, 2, 3)")).collect()
    assert {r["distance"] for r in few} == {0} and len({r["cluster"] for r in few}) == 3
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(40)], "vec_id long, embedding array<float>")
    assert {tuple(r)[1:5] for r in cc.centroid_clusters(same).collect()} == {(0, 0, 0, 0)}


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 3, 64) * 40_000.0).tolist()) for i in range(50)]
    got = cc.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        cc.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=100)
