"""Operator 6: near-duplicate embeddings by an exact metric range join.

Equal vectors are one class first, so that copies cost nothing. Pivots, a sample of the vectors that
grows with their number up to PIVOT_BYTES, divide the classes into cells: a vector's home is the nearest pivot's cell. Two vectors
within the angle t of one another, u at home in cell j and v in cell h, satisfy by the triangle
inequality d(v, p_j) <= radius_j + t; and v is then within t of the great circle that divides the
two cells, sin t >= (v.p_h - v.p_j) / |p_h - p_j|. A vector is copied to each cell of a higher
number for which both hold, and to no other, so every linked pair meets in exactly one cell, that
of the higher number. Cells are joined apart from one another. A cell is dealt out in tiles, one
for each pair of a block of its own vectors and a block of all that it holds, so no task holds more
than two blocks, bounded in rows and bytes, however many vectors crowd round one pivot.

Links are never written as pairs: a tile counts each vector's links and gives a forest, each
linked vector with the smallest that it reaches within the tile. In high dimensions without
clusters the triangle inequality excludes few cells, and the work nears that of all pairs.

Defined cases: vectors that are null, zero, or hold a null or a component that isn't finite link
with nothing, as do rows without vec_id; vectors of different lengths don't link; equal rows are
vectors of their own and link, and so are different vectors that share a vec_id; products that
rounding leaves at the limit or above it link; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import grouped, matrix, stored
from fuseline.llm.graph import leads

COSINE, BLOCK = 0.9, 4096
#: Pivots, which all tasks get, and a block's vectors take at most so many bytes as doubles.
PIVOT_BYTES, BLOCK_BYTES = 1 << 25, 1 << 25
#: Rounding of an angle or a product that must not lose a pair.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow for large components."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b, each one's smallest reachable node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Cells:
    """Homes and copies of vectors for given unit pivots of one length."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots, self.angle = pivots, math.acos(cosine)

    def place(self, vectors: np.ndarray, radius: np.ndarray | None = None, cells: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, homes, cosine to the home's pivot, whether each is copied to each cell) of strips
        of vectors, so that a strip's rows times the pivots are bounded."""
        step = max(1, cells // len(self.pivots))
        for s in range(0, len(vectors), step):
            near = unit(vectors[s : s + step]) @ self.pivots.T
            home = near.argmax(axis=1)
            own = near[np.arange(len(home)), home]
            apart = np.sqrt(np.maximum(0, 2 - 2 * self.pivots[home] @ self.pivots.T))
            to = own[:, None] - near <= math.sin(self.angle) * apart + SLACK
            to &= np.arange(len(self.pivots))[None, :] > home[:, None]
            if radius is not None:
                to &= np.arccos(np.clip(near, -1, 1)) <= radius[None, :] + self.angle + SLACK
            yield s, home, own, to


def _join_tile(u: dict, v: dict, cosine: float, strip: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, smallest id reached) of the tile's linked vectors. u: the cell's own block;
    v: a block of what the cell holds, own says which of it are at home there."""
    x, y = unit(u["x"]), unit(v["x"])
    mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    ids = np.concatenate((u["ids"], v["ids"]))
    every, at = np.unique(ids, return_inverse=True)
    label = np.arange(len(every))
    for s in range(0, len(x), strip):
        hit = x[s : s + strip] @ y.T >= cosine
        hit &= u["ids"][s : s + strip, None] != v["ids"][None, :]
        if not hit.any():
            continue
        mine[s : s + strip] = hit @ v["n"]
        theirs += np.where(v["own"], 0, u["n"][s : s + strip] @ hit)
        a, b = np.nonzero(hit)
        label = stars(len(every), np.concatenate((at[a + s], np.arange(len(every)))), np.concatenate((at[len(x) + b], label)))
    links = np.zeros(len(every), np.int64)
    np.add.at(links, at, np.concatenate((mine, theirs)))
    some = np.flatnonzero((links > 0) | (label != np.arange(len(every))))
    return every[some], links[some], every[label[some]]


_KEY = ["cell", "i", "k"]


def range_join(classes: DataFrame, dim: int, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """id, links, least of classes (rep, n, embedding of one length); one row for each tile in
    which a class has links. links counts copies."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], "id long, links long, least long")
    block = max(1, min(block, BLOCK_BYTES // (8 * dim)))
    wanted = max(1, min(math.ceil(n / block), math.isqrt(n), PIVOT_BYTES // (8 * dim)))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("embedding").collect()
    cells = Cells(unit(np.array([r[0] for r in rows])), cosine)
    count = len(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, radius = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count)
        for batch in batches:
            for _, home, near, to in cells.place(matrix(batch.column("embedding"))):
                own += np.bincount(home, minlength=count)
                held += to.sum(axis=0)
                np.maximum.at(radius, home, np.arccos(np.clip(near, -1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(own), pa.array(held), pa.array(radius)], names=["cell", "own", "held", "radius"])

    shape = classes.mapInArrow(measure, "cell int, own long, held long, radius double").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("held").alias("held"), F.max("radius").alias("radius")).orderBy("cell").collect()
    radius = np.array([r["radius"] for r in shape])
    blocks = np.array([max(1, math.ceil(r["own"] / block)) for r in shape], np.int32)
    parts = np.array([max(1, math.ceil((r["own"] + r["held"]) / block)) for r in shape], np.int32)
    real = "array<double>" if dict(classes.dtypes)["embedding"] == "array<double>" else "array<float>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its cells, its home first, and how many blocks and parts these have."""
        for batch in batches:
            for s, home, _, to in cells.place(matrix(batch.column("embedding")), radius):
                row, cell = np.nonzero(to)
                row, cell = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell)).astype(np.int32)
                order = np.argsort(row, kind="stable")
                row, cell = row[order], cell[order]
                at = pa.array(np.searchsorted(row, np.arange(len(home) + 1)).astype(np.int32))
                to_cells = pa.StructArray.from_arrays([pa.array(cell), pa.array(blocks[cell]), pa.array(parts[cell])], names=["cell", "blocks", "parts"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s, len(home)) for c in ("rep", "n", "embedding")), pa.ListArray.from_arrays(at, to_cells)], names=["rep", "n", "embedding", "cells"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, _KEY):
            home = t["home"].to_numpy()
            sides = [t.filter(pa.array(x)) for x in (home, ~home)]
            if all(x.num_rows for x in sides):
                u, v = ({"ids": x["rep"].to_numpy(), "n": x["n"].to_numpy(), "own": x["own"].to_numpy(), "x": matrix(x["embedding"])} for x in sides)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _join_tile(u, v, cosine)], names=["id", "links", "least"])

    placed = classes.select("rep", "n", "embedding").mapInArrow(deal, f"rep long, n long, embedding {real}, cells array<struct<cell: int, blocks: int, parts: int>>")
    placed = placed.select("rep", "n", "embedding", F.posexplode("cells").alias("at", "c")).select("rep", "n", "embedding", (F.col("at") == 0).alias("own"), "c.*")
    block_of, part_of = (F.pmod(F.xxhash64("rep", "cell", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("blocks", "parts")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_home = F.transform(upto("parts"), lambda k: F.struct(F.col("b").alias("i"), k.alias("k"), F.lit(True).alias("home")))
    as_held = F.transform(upto("blocks"), lambda i: F.struct(i.alias("i"), F.col("p").alias("k"), F.lit(False).alias("home")))
    roles = F.explode(F.when(F.col("own"), F.concat(as_home, as_held)).otherwise(as_held))
    placed = placed.withColumns({"b": block_of, "p": part_of}).withColumn("role", roles).select("cell", "role.*", "own", "rep", "n", "embedding")
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(tile, "id long, links long, least long")


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    real = "array<double>" if dict(vectors.dtypes)["embedding"] == "array<double>" else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(real).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.filter(sound)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("lead"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = None
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        part = range_join(classes.filter(F.size("embedding") == dim), dim, cosine, block)
        found = part if found is None else found.unionByName(part)
    none = F.lit(0).cast("long")
    if found is None:
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "tiles")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    linked = leads(found.select(F.col("id").alias("a"), F.col("least").alias("b")), classes.select(F.col("rep").alias("node"), "lead"))
    linked = linked.select(F.col("node").alias("rep"), F.col("lead").alias("least"))
    facts = classes.join(links, "rep", "left").join(linked, "rep", "left")
    facts = facts.select("embedding", (F.coalesce("links", none) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "lead").alias("component_id"))
    out = good.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter(~sound).select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Rounded as the operator's sums are: no pair of these tables is as near the limit as 1e-9.
ORACLE_SQL = {
    "op6_embedding_range_join": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c LEFT JOIN deg d ON c.vec_id = d.vec_id
"""
}
