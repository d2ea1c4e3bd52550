"""Operator 12: centroid clustering in whole numbers, with annulus search.

The centroids are sorted by norm. For a vector, the exact distance to the centroid whose norm is nearest to its own
is an upper bound u of the distance to its centroid; by the triangle inequality only centroids with a norm from |x| - u to |x| + u
can be as near. Binary search finds that annulus, and its members alone are compared, with exact
distances. The annulus is widened by more than norms are rounded, so that a centroid on its border, which may tie, is compared.

All is whole numbers: components are floor(scale * x), new centroids floor(sum / count), distances squared. So sums
may be taken in any order, and every run gives the same. Distances are worked out in doubles where all their
sums are below 2**53 and in 64-bit integers beyond.

The kept vectors are written once as integers. A round reads them, and each task gives a row of sums for each centroid it met;
the driver sees the sums over all tasks, a row for each centroid's component, and sends the centroids out again. There is no shuffle of
vectors, and a cluster that holds most of them costs as much as any.

Defined cases: vectors that are null, of another length or hold a null or a component that isn't finite are left out, as are
those with a component of LARGEST or more, whose squared distances would not fit 64 bits; fewer kept vectors than centroids make fewer centroids; the first
centroids are the least by hash, then vec_id, then components, and rows without vec_id come last;
equal rows and rows that share a vec_id are vectors of their own; equal centroids leave the higher number
empty; sums of distances that don't fit 64 bits are null; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import matrix, stored, table

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3:"
#: Whole components below it: squared distances of DIM = 64 of them fit 64-bit integers.
LARGEST = 1 << 27
#: By more than norms and bounds in doubles are rounded.
SLACK = 1e-9
STRIP = 1 << 13


class Annulus:
    """Nearest centroids by exact squared distance, the smaller number at ties."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64).reshape(len(centroids), -1)
        norms = np.sqrt(_squares(self.centroids))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row, and how many distances were worked out."""
        if not len(vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # 64 squares of differences below 2**23 sum to less than 2**53.
        fits = vectors.shape[1] * 4 * max(np.abs(vectors).max(), np.abs(self.centroids).max()).astype(float) ** 2 < 2.0**53
        kind = np.float64 if fits else np.int64
        x, c = vectors.astype(kind), self.centroids.astype(kind)
        norm = np.sqrt(_squares(vectors))
        at = np.clip(np.searchsorted(self.norms, norm), 0, len(c) - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(np.abs(self.norms[below] - norm) < np.abs(self.norms[at] - norm), below, at)
        best, n = self.order[at], len(x)
        bound = _squares(x - c[best])
        reach = np.sqrt(bound) * (1 + SLACK) + SLACK * (1 + norm + self.norms[-1])
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        rows = np.argsort(low, kind="stable")
        starts = low[rows]
        for k, number in enumerate(self.order):
            some = rows[: np.searchsorted(starts, k, "right")]
            some = some[(high[some] > k) & (at[some] != k)]
            if len(some):
                d, n = _squares(x[some] - c[number]), n + len(some)
                nearer = (d < bound[some]) | ((d == bound[some]) & (number < best[some]))
                bound[some[nearer]], best[some[nearer]] = d[nearer], number
        return best, bound.astype(np.int64), n


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the whole components, of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.lit(float(scale)) * e).alias("x"))
    sound = F.forall("x", lambda e: e.isNotNull() & (F.abs(e) < float(LARGEST)))  # neither not a number (which is above all) nor infinite
    return rows.filter((F.size("x") == dim) & F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("x", lambda e: F.floor(e).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = kept.select("v", "vec_id", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "vec_id", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    dim = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, count, total = Annulus(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for x in _strips(batches):
            near = find.nearest(x)[0]
            count += np.bincount(near, minlength=len(count))
            for j in np.unique(near):
                total[j] += x[near == j].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]), "total": pa.FixedSizeListArray.from_arrays(pa.array(total[some].reshape(-1)), dim).cast(pa.list_(pa.int64()))})

    parts = kept.select("v").mapInArrow(sums, "cluster int, n long, total array<long>")
    of_each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for cluster, i, n, s in of_each.collect():
        out[cluster, i] = int(s) // n
    return out


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for s in range(0, batch.num_rows, STRIP):
            yield matrix(batch.column("v").slice(s, STRIP)).astype(np.int64)


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row of vectors (vec_id, embedding)."""
    if dim * 4 * LARGEST**2 > 1 << 62:
        raise ValueError(f"squared distances of {dim} components don't fit 64 bits")
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, dim, scale), "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(kept, centroids)
        if np.array_equal(after, centroids):  # so do all further rounds
            break
        centroids = after

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Annulus(centroids)
        for batch in batches:
            for s in range(0, batch.num_rows, STRIP):
                part = batch.slice(s, STRIP)
                near, distance, _ = find.nearest(matrix(part.column("v")).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(near, pa.int32()), "distance": pa.array(distance)})

    assigned = stored(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fitting = lambda n: n if n < 1 << 63 else None
    names = [(j, fitting(inertia.get(j, 0)), fitting(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int) -> str:
    """All rounds one after the other, on components as rows."""
    near = "SELECT {cols} FROM x JOIN {c} c ON c.i = x.i GROUP BY r, c.k QUALIFY row_number() OVER (PARTITION BY r ORDER BY sum((v - w) * (v - w)), c.k) = 1"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED ({near.format(cols='r, c.k AS k, sum((v - w) * (v - w))::BIGINT AS distance', c=f'c{t}')})")
        if t < rounds:
            steps.append(f"""m{t} AS MATERIALIZED (SELECT k, x.i, sum(v)::BIGINT AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY k, x.i),
c{t + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, w) AS w FROM c{t} c LEFT JOIN m{t} m ON m.k = c.k AND m.i = c.i)""")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: 1024 * e::DOUBLE) AS e FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, vec_id, unnest(generate_series(1, {DIM})) AS i, floor(unnest(e))::BIGINT AS v FROM d),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), vec_id) - 1 AS k FROM d QUALIFY k < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT k, i, v AS w FROM f JOIN x USING (r)),
{', '.join(steps)},
h AS (SELECT k, sha256(string_agg(w::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN d USING (r) JOIN h USING (k)
"""


ORACLE_SQL = {"op12_annulus_clusters": _sql(ROUNDS)}
