"""Operator 4: n-gram Jaccard join by chosen paths.

Sets are the hashes of a text's runs of five words; texts with the same set are one class and its
members cost nothing. A set's token at a coordinate is the one of least hash under that
coordinate's function, so two sets share it with the probability of their Jaccard similarity.
A run starts from all sets at its root; every node samples BRANCH coordinates and sends each set
to the child of its token there. Nodes with one set end; nodes of at most limit sets are leaves to
be joined by brute force; larger nodes are split again, up to depth times, unless a child would keep
most of the node (a group of near copies): such a node is a leaf too. A pair at the threshold
survives a run with a known probability, and runs are repeated until the target recall:
see runs_needed().

Leaves are dealt out in tiles, pairs of blocks bounded in rows and in tokens, so no task holds more
than two blocks. A pair meets in several leaves and counts only in the first they share. Sketches of
the coordinates rule out pairs far below the threshold; the sets of what is left are compared
exactly. Pairs are never written: a tile counts each set's links, weighted by class members, and
gives a forest, each linked set with the least that it reaches within the tile. There is no cap
on partners, buckets or candidates.

Defined cases: null or empty texts, and texts without words, link with nothing; a text of fewer
than five words has one token, all its words; rows that repeat are members of one class; rows that
share a doc_id but not a text are documents of their own, told apart by the text's hash; of those
in one group that have its least doc_id, the one of least hash is kept; rows without
doc_id link with nothing; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import WORD, grouped, matrix, mix64, pieces, shingle_sets, stored, text_or_empty
from fuseline.llm.embedding_join import stars
from fuseline.llm.graph import leads

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
BRANCH, DEPTH, LIMIT, BLOCK, COORDINATES = 2, 3, 1024, 128, 64
#: Tokens of a block's sets together (16 MB), on average.
TOKENS = 1 << 21
#: A node one of whose children would keep more than this share of it isn't split.
PROGRESS = 0.5


def survival(similarity: float, branch: int, depth: int) -> float:
    """Probability that a pair of this similarity shares a path of so many levels in a run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - similarity * q) ** branch
    return q


def runs_needed(similarity: float, branch: int, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, branch, depth))))


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(sets: list[np.ndarray], roots: int, coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class: two sums over the set, 64-bit tokens at the first roots coordinates, 32-bit tokens
    at all) of sets that aren't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    name = np.stack([np.add.reduceat(mix64(flat), starts), np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)], axis=1)
    wide, narrow = np.empty((len(sets), roots), np.uint64), np.empty((len(sets), coordinates), np.uint32)
    for k, a in enumerate(_multipliers(coordinates)):
        least = np.minimum.reduceat(flat * a, starts)
        narrow[:, k] = least >> np.uint64(32)
        if k < roots:
            wide[:, k] = least
    return name.view(np.int64), wide.view(np.int64), narrow.view(np.int32)


def sketches(docs: DataFrame, words: int, roots: int, coordinates: int) -> DataFrame:
    """doc_id, h (the text's hash), c1, c2 (the class), size, roots and tokens of each row of docs
    that has words."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), text_or_empty().alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column("text")):
                sets = shingle_sets(texts, words)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    kept = [sets[i] for i in some]
                    name, wide, narrow = sketch(kept, roots, coordinates)
                    at = pa.array([start + i for i in some])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array([len(s) for s in kept], pa.int32()), pa.array(list(wide), pa.list_(pa.int64())), pa.array(list(narrow), pa.list_(pa.int32()))],
                        names=["doc_id", "h", "c1", "c2", "size", "roots", "tokens"],
                    )

    return rows.mapInArrow(make, "doc_id long, h long, c1 long, c2 long, size int, roots array<long>, tokens array<int>")


def leaves(classes: DataFrame, branch: int, depth: int, limit: int, coordinates: int) -> DataFrame:
    """rep, size, place, leaf, m, w: each class's leaves with more than one class, of m with w tokens. place numbers
    the paths of coordinates; a class has at most one leaf in each place."""
    nodes = classes.select("rep", "size", F.posexplode("roots").alias("place", "token")).select("rep", "size", "place", F.xxhash64("place", "token").alias("leaf"))
    out = None
    for level in range(1, depth + 1):
        size = nodes.groupBy("leaf").agg(F.count("*").alias("m"), F.sum("size").alias("w")).filter("m > 1")
        nodes = stored(nodes.join(size, "leaf"), f"level{level}")
        big = nodes.filter(F.col("m") > limit)
        if level == depth or big.isEmpty():
            return nodes if out is None else out.unionByName(nodes)
        pick = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.pmod(F.xxhash64("leaf", F.lit(b)), F.lit(coordinates)).cast("int").alias("c")) for b in range(branch)]))
        children = big.join(classes.select("rep", "tokens"), "rep").select("rep", "size", "leaf", "place", "m", "tokens", pick.alias("p"))
        children = children.select("rep", "size", (F.col("place") * branch + F.col("p.b") + 1000 * level).cast("int").alias("place"), F.col("leaf").alias("parent"), "m", F.xxhash64("leaf", "p.c", F.get("tokens", F.col("p.c"))).alias("leaf"))
        children = stored(children, f"children{level}")
        share = children.groupBy("parent", "leaf").agg(F.count("*").alias("n"), F.first("m").alias("m"))
        stuck = share.groupBy("parent").agg((F.max("n") > PROGRESS * F.first("m")).alias("stuck"))
        ends = big.join(stuck.filter("stuck").select(F.col("parent").alias("leaf")), "leaf", "left_semi")
        done = nodes.filter(F.col("m") <= limit).unionByName(ends.select(nodes.columns))
        out = done if out is None else out.unionByName(done)
        nodes = children.join(stuck.filter("not stuck").select("parent"), "parent", "left_semi").select("rep", "size", "place", "leaf")
    return out


def _tiles(rows: DataFrame, block: int, tokens: int) -> DataFrame:
    """rows (leaf, rep, m, w, ...) for each tile of their leaf: i, j, and block, the row's own."""
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("w") / tokens)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "leaf"), F.col("blocks")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return rows.withColumn("t", F.explode(tile)).withColumns({"i": F.col("t.i"), "j": F.col("t.j")}).drop("t", "blocks", "w")


def _agreement(tokens: np.ndarray) -> np.ndarray:
    """At how many coordinates each two rows agree."""
    n = len(tokens)
    if n <= 48:
        return (tokens[:, None, :] == tokens[None, :, :]).sum(axis=2)
    out = np.zeros((n, n), np.uint8 if tokens.shape[1] < 256 else np.int32)
    for k in range(tokens.shape[1]):
        c = tokens[:, k]
        out += c[:, None] == c[None, :]
    return out


def _wanted(tokens: np.ndarray, sizes: np.ndarray, places: np.ndarray, leaf_of: np.ndarray, place: int, block: np.ndarray, i: int, j: int, similarity: float) -> np.ndarray:
    """Which pairs (upper triangle) of a tile may be similar and count in this leaf."""
    t = tokens.shape[1]
    enough = max(0, math.floor(t * similarity - 4.5 * math.sqrt(t * similarity * (1 - similarity))))
    ok = np.triu(_agreement(tokens) >= enough, 1)
    ok &= np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    if i != j:
        ok &= block[:, None] != block[None, :]
    if ok.any():
        for p in np.flatnonzero(places < place):
            c = leaf_of[:, p]
            ok &= ~((c[:, None] == c[None, :]) & (c != 0)[:, None])
    return ok


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many tokens each pair (row, column) of sets shares."""
    if len(pairs) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count > 1
    number = np.cumsum(use) - 1
    keep = use[at]
    owner, at = owner[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [first, first + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], at[a:b] - first] = 1
        rows = np.flatnonzero(x.any(axis=1))
        part = x[rows]
        both[np.ix_(rows, rows)] += part @ part.T
    return both[pairs[:, 0], pairs[:, 1]].astype(np.int64)


_TILE = ["leaf", "i", "j"]


def _grouping(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, branch: int = BRANCH, depth: int = DEPTH, limit: int = LIMIT, block: int = BLOCK, coordinates: int = COORDINATES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, c1, c2 of each row with words; c1, c2, n_links and lead, the least (doc_id, h) that
    links lead to, of each class)."""
    spark = docs.sparkSession
    roots = branch * runs_needed(similarity, branch, depth, recall)
    sets = stored(sketches(docs, words, roots, coordinates), "sketches")
    classes = sets.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "h")).alias("lead"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    places = stored(leaves(classes, branch, depth, limit, coordinates), "leaves")
    order = sorted(r[0] for r in places.select("place").distinct().collect())  # at most the paths' number
    per = places.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("place", "leaf"))).alias("by"))
    row = F.array(*[F.coalesce(F.try_element_at("by", F.lit(p)), F.lit(0).cast("long")) for p in order]) if order else F.array().cast("array<long>")
    facts = stored(classes.join(per, "rep").select("rep", "lead", "n", "tokens", row.alias("leaf_of")), "facts")
    tiles = _tiles(places.join(facts.select("rep", "tokens", "leaf_of"), "rep"), block, TOKENS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = np.array(order)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        size = 0
        for t in grouped(batches, _TILE):
            if t.num_rows < 2:
                continue
            ok = _wanted(matrix(t["tokens"]), t["size"].to_numpy(), number, matrix(t["leaf_of"]), t["place"][0].as_py(), t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py(), similarity)
            some = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(some):
                out.append(t.select(_KEPT).take(some))
                size += len(some)
            if size > 5000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    kept_shape = "leaf long, i int, j int, place int, block int, rep long"
    dealt = tiles.repartition(parts, *_TILE).sortWithinPartitions(*_TILE)
    found = stored(dealt.mapInArrow(candidates, kept_shape), "candidates")
    homes = found.groupBy("rep").agg(F.collect_list(F.struct("leaf", "i", "j", "place", "block")).alias("tiles"))
    wanted = stored(homes.join(facts.select("rep", "lead.doc_id", "lead.h", "n", "leaf_of"), "rep"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), text_or_empty().alias("text"))
    texts = texts.join(wanted, ["doc_id", "h"]).dropDuplicates(["rep"])  # repeated rows

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in ("rep", "n", "leaf_of", "tiles")]
            for start, part in pieces(batch.column("text")):
                out: dict[str, list] = {k: [] for k in _SHIPPED.names}
                size = 0
                for s, rep, n, leaf_of, homes in zip(shingle_sets(part, words), *(c.slice(start, len(part)).to_pylist() for c in columns), strict=True):
                    for h in homes:
                        for k, v in (*h.items(), ("rep", rep), ("n", n), ("leaf_of", leaf_of), ("shingles", s.tobytes())):
                            out[k].append(v)
                        size += 8 * len(s)
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pydict(out, schema=_SHIPPED)
                            out, size = {k: [] for k in _SHIPPED.names}, 0
                if size:
                    yield pa.RecordBatch.from_pydict(out, schema=_SHIPPED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, _TILE):
            rep, first = np.unique(t["rep"].to_numpy(), return_index=True)
            if len(rep) < 2:
                continue
            t = t.take(first)
            sets_ = [np.frombuffer(b, np.uint64) for b in t["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets_])
            tokens = sketch(sets_, 0, coordinates)[2]
            i, j, n = t["i"][0].as_py(), t["j"][0].as_py(), t["n"].to_numpy()
            ok = _wanted(tokens, sizes, number, matrix(t["leaf_of"]), t["place"][0].as_py(), t["block"].to_numpy(), i, j, similarity)
            pairs = np.argwhere(ok)
            if not len(pairs):
                continue
            common, total = _common(sets_, pairs), sizes[pairs].sum(axis=1)
            pairs = pairs[common * (1 + similarity) >= similarity * total - 1e-9]
            if len(pairs):
                links = np.zeros(len(rep), np.int64)
                np.add.at(links, pairs[:, 0], n[pairs[:, 1]])
                np.add.at(links, pairs[:, 1], n[pairs[:, 0]])
                some = np.flatnonzero(links)
                least = rep[stars(len(rep), pairs[:, 0], pairs[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(least[some])], names=["id", "links", "least"])

    shipped = texts.mapInArrow(ship, "leaf long, i int, j int, place int, block int, rep long, n long, leaf_of array<long>, shingles binary")
    linked = stored(shipped.repartition(parts, *_TILE).sortWithinPartitions(*_TILE).mapInArrow(join, "id long, links long, least long"), "linked")
    links = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    comp = leads(linked.select(F.col("id").alias("a"), F.col("least").alias("b")), classes.select(F.col("rep").alias("node"), "lead"))
    comp = comp.select(F.col("node").alias("rep"), F.col("lead").alias("group_lead"))
    known = classes.select("c1", "c2", "rep", "n", "lead").join(links, "rep", "left").join(comp, "rep", "left")
    return sets.select("doc_id", "h", "c1", "c2"), stored(known.select("c1", "c2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.coalesce("group_lead", "lead").alias("lead")), "known")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id that links lead to), n_links (other documents linked
    directly) and kept (whether it is its class's least) of each row of docs (doc_id, text). options:
    words, similarity, recall and the sizes of the search, as _grouping() has them."""
    sets, known = _grouping(docs, **options)
    out = sets.join(known, ["c1", "c2"]).select("doc_id", F.col("lead.doc_id").alias("class_id"), "n_links", (F.struct("doc_id", "h") == F.col("lead")).alias("kept"))
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col("text").rlike(WORD), F.lit(False)) & F.col("doc_id").isNotNull()).alias("worded"))
    rest = worded.filter("not worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(rest)


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, one that has its least doc_id, and all rows without doc_id or
    words. Repeated rows count as copies."""
    sets, known = _grouping(docs.select("doc_id", "text"), **options)
    names = sets.groupBy("doc_id", "h", "c1", "c2").agg(F.count("*").alias("n")).join(known, ["c1", "c2"])
    names = stored(names.select(F.col("doc_id").alias("_fuseline_id"), F.col("h").alias("_fuseline_h"), "n", (F.struct("doc_id", "h") == F.col("lead")).alias("kept")), "names")
    same = (F.col("doc_id").cast("long") == F.col("_fuseline_id")) & (F.xxhash64("text") == F.col("_fuseline_h"))
    gone, twice = names.filter("not kept").select("_fuseline_id", "_fuseline_h"), names.filter("kept and n > 1").select("_fuseline_id", "_fuseline_h")
    left = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return left
    again = left.join(twice, same, "left_semi").withColumns({"_fuseline_id": F.col("doc_id").cast("long"), "_fuseline_h": F.xxhash64("text")})
    return left.join(twice, same, "left_anti").unionByName(again.dropDuplicates(["_fuseline_id", "_fuseline_h"]).select(*docs.columns))


_KEPT = ["leaf", "i", "j", "place", "block", "rep"]
_SHIPPED = pa.schema([("leaf", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("leaf_of", pa.list_(pa.int64())), ("shingles", pa.binary())])


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The join of all pairs that share a run of words, then the classes.
ORACLE_SQL = {
    "op4_shingle_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], chr(10)))
    WHEN len(ws) > 0 THEN [array_to_string(ws, chr(10))] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 1.8 >= 0.8 * (x.size + y.size) - 1e-9),
link AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n, 0) AS n_links, c.doc_id = class_id AS kept FROM comp c LEFT JOIN deg d ON c.doc_id = d.doc_id
"""
}
