"""Operator 13: a conversation prefix trie by Patricia construction.

A conversation is the row of its turns' digests, 16 bytes a turn, so that byte order is an order of sequences
in which a prefix comes first and all that share one are neighbours. The rows are range-partitioned by digests and conv_id,
which cuts even the copies of one conversation apart, and sorted.

Each task goes once through its sorted rows with a stack of the points on the current path: where sequences
branch, end, or are leaves, and nothing between. The length of the common prefix of two neighbours says which points are complete; a complete point
adds its members, leaves and saved tokens to the one below and is written with its edge, the depths between the two. A
task holds one path, however many conversations go through it.

A node whose conversations may go on in another task is a prefix of the task's first or last sequence. Of those two paths every
node is written alone, with what its complete subtrees add to it, and the nodes of all tasks meet by their digest in one
partial aggregation. Their subtrees are summed along the paths: what a node adds is counted on one of the paths through
it, added up from each path's end (a running sum), and a node's total is the sum over its paths. So rows and work stay linear in the depth.

At last the edges are unfolded: a node within an edge has the members and leaves of the edge's upper end, and that end's saved tokens with
those of the edge's rest, a sum from its end. A list of ends is hashed as its sorted ids go by; lists that go on in another task, or
are long, are written in pieces that are hashed in their order.

Defined cases: null role and text are empty; a null turn comes first, and rows of a conversation that share a turn
go by the MD5 digest of role and text; rows without conv_id are left out; repeated rows are turns of their own; c - c % 20
takes the remainder's sign from c; conversations without turns are members of the root; an empty table gives no rows; other
columns are ignored. A conversation's digests and word counts are one row (20 bytes a turn), its texts never are."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuseline.llm.common import WORD, stored, table

#: Conversations that share a base, and how many of its turns at most a conversation starts with.
FAMILY, HEADS = 20, 4
#: Bytes of a turn's digest, and of a piece of a list of ends.
WIDTH, PIECE = 16, 1 << 20
ROOT = bytes(WIDTH)
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an ordered array of (digest, words), of turns (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """conv_id and the rebuilt conversation: digests in one string of bytes, and words."""
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    heads = lists.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("first"))
    own = lists.select("conv_id", base.alias("base"), h.alias("h"), "turns")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)"))
    rest = F.filter("turns", lambda _, i: i >= F.col("h"))
    rows = own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


class Point:
    """A branch, end or leaf on the current path. saved and leaves: of the complete subtrees above it."""

    __slots__ = ("depth", "n", "conv", "leaves", "saved", "children", "ends")

    def __init__(self, depth: int):
        self.depth, self.n, self.conv, self.leaves, self.saved, self.children, self.ends = depth, 0, None, 0, 0, 0, NOTHING


#: A row of what a task writes. kind "edge": a complete point and its edge; "node": of the task's first (side 0) or last path; "ends": a piece of a list.
PARTS = "kind string, side int, depth int, id binary, parent binary, n long, conv_id long, leaves long, saved long, children long, rest array<long>, ends string, first long, piece string"
_FIELDS = [f.split()[0] for f in PARTS.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.string()]


class Builder:
    """The compressed trie of sorted (key, words, conv_id); add() and finish() yield rows of PARTS."""

    def __init__(self, piece: int = PIECE):
        self.piece, self.stack, self.key, self.words, self.ids = piece, [Point(0)], None, [], [ROOT]
        self.first_depth = 0  # of the last sequence's prefix that the first one shares
        self.run: list[int] = []
        self.run_bytes, self.in_pieces, self.is_first = 0, False, True

    def add(self, key: bytes, words: list[int], conv_id: int) -> Iterator[dict]:
        if key != self.key:
            if self.key is None:
                shared = 0
                self.first_depth = len(key) // WIDTH
            else:
                yield from self._end_run()
                self.is_first = False
                shared = self._shared(key)
                yield from self._pop(shared, 0)
                self.first_depth = min(self.first_depth, shared)
            del self.ids[shared + 1 :]
            for d in range(shared, len(key) // WIDTH):
                self.ids.append(hashlib.md5(self.ids[-1] + key[d * WIDTH : (d + 1) * WIDTH]).digest())
            self.key, self.words = key, words
            if self.stack[-1].depth < len(key) // WIDTH:
                self.stack.append(Point(len(key) // WIDTH))
        top = self.stack[-1]
        top.n += 1
        top.conv = conv_id if top.conv is None else min(top.conv, conv_id)
        self.run.append(conv_id)
        self.run_bytes += 20
        if self.run_bytes >= self.piece:
            self.in_pieces = True
            yield self._piece()

    def _shared(self, key: bytes) -> int:
        """Turns at the start of key that are the last sequence's."""
        low, high = 0, min(len(key), len(self.key)) // WIDTH
        if key.startswith(self.key):
            return high
        while low < high:  # the longest equal prefix
            mid = (low + high + 1) // 2
            low, high = (mid, high) if key[: mid * WIDTH] == self.key[: mid * WIDTH] else (low, mid - 1)
        return low

    def _piece(self) -> dict:
        out = {"kind": "ends", "id": self.ids[-1], "first": self.run[0], "piece": ",".join(map(str, self.run))}
        self.run, self.run_bytes = [], 0
        return out

    def _end_run(self, open_: bool = False) -> Iterator[dict]:
        """The current sequence has no more rows here; open_: the task's last may have some in another task."""
        if self.in_pieces or self.is_first or open_:
            if self.run:
                yield self._piece()
            self.stack[-1].ends = None
        else:
            self.stack[-1].ends = hashlib.sha256(",".join(map(str, self.run)).encode()).hexdigest()
        self.run, self.run_bytes, self.in_pieces = [], 0, False

    def _pop(self, depth: int, side: int | None) -> Iterator[dict]:
        """Take the points beyond depth off the path."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            below = self.stack[-1]
            below.n += point.n
            below.conv = point.conv if below.conv is None else min(below.conv, point.conv)
            if point.depth <= self.first_depth:
                yield from self._nodes(point, below.depth, 0)
                continue
            rest = list(itertools.accumulate(reversed(self.words[below.depth : point.depth])))[::-1]
            point.leaves += point.children == 0
            yield {"kind": "edge", "depth": point.depth, "id": self.ids[point.depth], "parent": self.ids[below.depth], "n": point.n, "conv_id": point.conv, "leaves": point.leaves, "saved": point.saved, "children": point.children, "rest": rest, "ends": point.ends}
            below.leaves += point.leaves
            below.saved += point.saved + (point.n - 1) * rest[0]
            below.children += 1

    def _nodes(self, point: Point, low: int, side: int) -> Iterator[dict]:
        """All nodes of a path from depth low on to the point."""
        for d in range(point.depth, low, -1):
            row = {"kind": "node", "side": side, "depth": d, "id": self.ids[d], "parent": self.ids[d - 1] if d else None, "n": point.n, "conv_id": point.conv, "leaves": 0, "saved": 0, "children": 0, "rest": [self.words[d - 1] if d else 0], "ends": NOTHING}
            yield row | ({"leaves": point.leaves, "saved": point.saved, "children": point.children, "ends": point.ends} if d == point.depth else {})

    def finish(self) -> Iterator[dict]:
        if self.key is None:
            return
        yield from self._end_run(open_=True)
        also = self.first_depth if not self.is_first else -1  # the first path's part that is the last one's too
        for d in range(also, -1, -1):
            yield {"kind": "node", "side": 0, "depth": d, "id": self.ids[d], "parent": self.ids[d - 1] if d else None, "n": 0, "leaves": 0, "saved": 0, "children": 0, "rest": [self.words[d - 1] if d else 0], "ends": NOTHING}
        n, conv = 0, None
        for k in range(len(self.stack) - 1, -1, -1):
            point = self.stack[k]
            n, conv = n + point.n, min(x for x in (conv, point.conv) if x is not None)
            point.n, point.conv = n, conv
            yield from self._nodes(point, self.stack[k - 1].depth if k else -1, 1)


def _batches(rows: Iterator[dict], size: int = 4096, bytes_: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row.get("piece") or "") + 8 * len(row.get("rest") or "")
        if len(held) == size or weight >= bytes_:
            yield _batch(held)
            held, weight = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [[r.get(c) for r in rows] for c in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_FIELDS)


def compressed(convs: DataFrame, partitions: int, piece: int = PIECE) -> DataFrame:
    """Each task's points (PARTS, and task) of convs (key, words, conv_id)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Builder(piece)
        rows = (r for b in batches for s in range(0, b.num_rows, 1024) for r in zip(*(b.column(c).slice(s, 1024).to_pylist() for c in ("key", "words", "conv_id")), strict=True))
        yield from _batches(itertools.chain((x for r in rows for x in trie.add(*r)), trie.finish()))

    ranged = convs.select("key", "words", "conv_id").repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ranged.mapInArrow(build, PARTS).withColumn("task", F.spark_partition_id())


def _hashed(parts: DataFrame, partitions: int) -> DataFrame:
    """id and ends of the lists that were written in pieces."""
    pieces = parts.filter("kind = 'ends'").select("id", "first", "piece").repartition(partitions, "id").sortWithinPartitions("id", "first")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in [(b.column("id")[i].as_py(), b.column("piece")[i].as_py())])
        for node, group in itertools.groupby(rows, lambda r: r[0]):
            digest = hashlib.sha256(next(group)[1].encode())
            for _, text in group:
                digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array([node], pa.binary()), "list": [digest.hexdigest()]})

    return pieces.mapInArrow(hash_all, "id binary, list string")


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes of all tasks' paths, one row each: their own figures and their subtrees'."""
    rows = parts.filter("kind = 'node'").withColumn("path", F.struct("task", "side"))
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")]
    nodes = rows.groupBy("id").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max(F.col("rest")[0]).alias("w"), F.min("path").alias("of"), F.max(F.when(F.col("ends") != NOTHING, F.col("ends"))).alias("ends"))
    above = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("open"))
    nodes = nodes.join(above, "id", "left").withColumn("children", F.col("children") + F.coalesce("open", F.lit(0)))
    nodes = nodes.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("w")})
    nodes = stored(nodes.drop("open"), "nodes")
    own = nodes.select("id", "of", F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"))
    mine = lambda c: F.when(F.col("of") == F.col("path"), F.col(c)).otherwise(0)  # noqa: E731
    to_end = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = rows.select("id", "path", "depth").join(own, "id").select("id", *[F.sum(mine(f"own_{c}")).over(to_end).alias(c) for c in ("leaves", "saved")])
    total = along.groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("leaves", "saved", "of", "w").join(total, "id")


def prefix_trie(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The nodes of turns (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    convs = stored(rebuilt(turn_lists(turns)), "conversations")
    parts = stored(compressed(convs, partitions, piece), "points")
    lists = _hashed(parts, partitions)
    single = _merged(parts).select("id", "parent", "conv_id", "depth", "n", "leaves", "saved", "children", "ends", F.array(F.lit(0).cast("long")).alias("rest"))
    points = parts.filter("kind = 'edge'").select(*single.columns).unionByName(single)
    points = stored(points.join(lists, "id", "left").withColumn("ends", F.coalesce("ends", "list", F.lit(NOTHING))).drop("list"), "trie")
    names = points.select(F.col("id").alias("parent"), F.col("conv_id").alias("up"))
    return _unfolded(points.join(names, "parent", "left"))


def _unfolded(points: DataFrame) -> DataFrame:
    """All nodes of the points' edges. rest: from each node of the edge on, the edge's words."""
    rows = points.withColumn("m", F.size("rest")).select("*", F.posexplode("rest").alias("k", "r"))
    top, last = F.col("k") == 0, F.col("k") == F.col("m") - 1
    return rows.select(
        "conv_id",
        (F.col("depth") - F.col("m") + F.col("k") + 1).cast("long").alias("depth"),
        F.when(top, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("r")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as lists of turns; crc32 bit by bit.
ORACLE_SQL = {
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h FROM t),
s AS (SELECT h.conv_id, coalesce(b.turns[:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN t b ON b.conv_id = h.base),
p AS MATERIALIZED (SELECT conv_id, d, turns[:d] AS k, len(turns) = d AS is_end FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^ 	-]+')) END AS saved FROM p GROUP BY d, k),
c AS (SELECT k[:d - 1] AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (k)),
u AS (SELECT k[:a] AS k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children, n_leaves, saved_tokens, m.ends AS ends_sha256
FROM m JOIN u USING (k) LEFT JOIN n up ON m.d > 0 AND up.k = m.k[:m.d - 1]
"""
}
