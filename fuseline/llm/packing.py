"""Operator 3: best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document's ids (with the end id) are one piece, or, if they are more than a sequence holds,
pieces of exactly a sequence's length after a first piece with the rest. Full pieces are
sequences of their own. The others are dealt evenly at random to islands' problems of a bounded
number of pieces. Each problem is solved by several islands, populations that evolve in tasks of
their own and keep all their members from round to round: crossover injects whole well-filled bins of one
parent into the other, drops bins that share pieces with them, and fits the displaced pieces again,
best fit first by swapping them for smaller pieces of open bins, then by falling size into what is free.
After each round every island's best packing migrates to the next island of its problem. An island
stops where its packing meets the lower bound, or no longer improves. Bins that the best packing fills well are
kept; the pieces of the rest go on, mixed anew, to the next pooling round, so what one problem
can't fill is filled with what others have left.

Defined cases: a null text counts as empty (its one piece holds the end id); rows that repeat
a doc_id are packed each; empty tables give no rows; further columns are ignored. The result is
the same in each run on the same rows, but for the numbers of sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import batches_of, gathered, stored, text_or_empty
from fuseline.llm.common import pieces as parts_of
from fuseline.llm.token_shards import END_ID, encoder
from fuseline.llm.tokens import TEXT_BYTES, tokenizer_path

CAPACITY = 1024
_LAST = 1 << 62  # after every piece of a size
_WORD = (1 << 30) - 1  # what Python counts with in one step
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for rows in gathered(batches, TEXT_BYTES):
            ids = rows.column("doc_id").to_pylist()
            out: list[tuple] = []
            for first, part in parts_of(rows.column("text"), TEXT_BYTES):
                for doc_id, got in zip(ids[first : first + len(part)], encode(part), strict=True):
                    got += end
                    n = len(got) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(doc_id, k, a, b - a, zlib.crc32(got[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return rows.mapInArrow(cut, PIECES)


class Bins:
    """Open bins by free room; finds the fullest one that takes a piece in a few steps: bit r of
    free says that some bin has room r. Lists of pieces are shared between packings and never changed."""

    def __init__(self, capacity: int, kept: list[tuple[list[int], int]] = ()):
        self.capacity, self.by_room, self.free = capacity, {}, 0
        self.bins: list[list[int]] = [items for items, _ in kept]
        self.room: list[int] = [room for _, room in kept]
        self._of: np.ndarray | None = None
        self._rooms: np.ndarray | None = None
        for b, room in enumerate(self.room):
            if room:
                self.by_room.setdefault(room, []).append(b)
        for room in self.by_room:
            self.free |= 1 << room

    def put(self, order: Iterable[int], sizes: list[int]) -> None:
        """The pieces of order, one after the other."""
        capacity, bins, rooms, by_room, free = self.capacity, self.bins, self.room, self.by_room, self.free
        for item in order:
            size = sizes[item]
            fits = free >> size
            if fits:
                low = fits & _WORD or fits  # a bin that a piece nearly fills is found in a few bits
                room = size + (low & -low).bit_length() - 1
                same = by_room[room]
                b = same.pop()
                if not same:
                    free ^= 1 << room
                bins[b] = [*bins[b], item]
                rooms[b] = room = room - size
            else:
                b, room = len(bins), capacity - size
                bins.append([item])
                rooms.append(room)
            if room:
                same = by_room.get(room)
                if same:
                    same.append(b)
                else:
                    by_room[room] = [b]
                    free |= 1 << room
        self.free = free

    def of(self, n: int) -> np.ndarray:
        """The bin of each of n pieces; asked for when nothing more is put in."""
        if self._of is None:
            self._of = np.zeros(n, np.int64)
            self._of[list(chain.from_iterable(self.bins))] = np.repeat(np.arange(len(self.bins)), list(map(len, self.bins)))
        return self._of

    def rooms(self) -> np.ndarray:
        """The bins' rooms; asked for when nothing more is put in."""
        if self._rooms is None:
            self._rooms = np.array(self.room, np.int64)
        return self._rooms


def best_fit(sizes: list[int], order, kept: list[tuple[list[int], int]], capacity: int) -> Bins:
    """The kept bins with the pieces of order best-fitted, one after the other, to them or new ones."""
    out = Bins(capacity, kept)
    out.put(order, sizes)
    return out


def fitness(p: Bins) -> tuple[int, float]:
    """Fewer bins are better; of as many bins, more uneven filling is."""
    return -len(p.bins), float((((p.capacity - p.rooms()) / p.capacity) ** 2).sum())


def _swap(items: list[int], room: int, loose: list[tuple[int, int]], sizes: list[int]) -> int:
    """Fill a bin better: a piece goes for a larger loose one, or for two. loose (size, piece) is in
    order and stays so. Gives the room left."""
    for at, item in enumerate(items):
        size = sizes[item]
        j = bisect_right(loose, (size + room, _LAST)) - 1
        if j >= 0 and loose[j][0] > size:
            gain, items[at] = loose[j][0] - size, loose[j][1]
            del loose[j]
            insort(loose, (size, item))
            room -= gain
            if not room:
                return 0
    for at, item in enumerate(items):
        size, found = sizes[item], (sizes[item], 0, 0)
        half = bisect_right(loose, ((size + room) // 2, _LAST))
        for j in range(0, half, max(1, half // 64)):  # some of the possible lighter ones
            k = bisect_right(loose, (size + room - loose[j][0], _LAST)) - 1
            if k > j and loose[j][0] + loose[k][0] > found[0]:
                found = (loose[j][0] + loose[k][0], j, k)
                if found[0] == size + room:
                    break
        if found[0] > size:
            _, j, k = found
            items[at : at + 1] = [loose[j][1], loose[k][1]]
            del loose[k], loose[j]
            insort(loose, (size, item))
            return room - (found[0] - size)
    return room


def refit(kept: list[tuple[list[int], int]], displaced: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """The kept bins with the displaced pieces fitted in: open bins, in random order, first swap pieces
    for larger ones, then what is left is best-fitted, the largest first."""
    found = np.array([sizes[i] for i in displaced], np.int64)
    by_size = np.lexsort((displaced, found))
    loose = list(zip(found[by_size].tolist(), np.asarray(displaced, np.int64)[by_size].tolist(), strict=True))
    for k in rng.permutation([k for k, (_, room) in enumerate(kept) if room]).tolist():
        if not loose:
            break
        items = list(kept[k][0])
        kept[k] = (items, _swap(items, kept[k][1], loose, sizes))
    return best_fit(sizes, [i for _, i in reversed(loose)], kept, capacity)


def crossover(a: Bins, b: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """a with well-filled bins of b injected whole; a's bins that share pieces with them are
    dropped, and so are its worst and a few others; their other pieces are fitted again."""
    n, rooms_a, rooms_b = len(sizes), a.rooms(), b.rooms()
    limit = np.quantile(rooms_b, rng.uniform(0.2, 0.6))
    injected = (rooms_b <= limit) & (rng.random(len(rooms_b)) < 0.5)
    taken = injected[b.of(n)]
    lost = (rooms_a > 0) & ((rooms_a >= np.quantile(rooms_a, 0.9)) | (rng.random(len(rooms_a)) < 0.02))
    lost[a.of(n)[taken]] = True
    kept = [*compress(zip(b.bins, b.room, strict=True), injected.tolist()), *compress(zip(a.bins, a.room, strict=True), (~lost).tolist())]
    return refit(kept, np.flatnonzero(lost[a.of(n)] & ~taken).tolist(), sizes, a.capacity, rng)


def lower_bound(sizes: list[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def evolve(sizes: list[int], capacity: int, population: list[Bins], children: int, rng: np.random.Generator, patience: int = 40) -> list[Bins]:
    """The population, best first, after so many children each replaced its worst member, if better;
    fewer where the lower bound is met or the last patience children saved no bin."""
    enough = lower_bound(sizes, capacity)
    scored = sorted(((fitness(p), p) for p in population), key=lambda x: x[0], reverse=True)
    waited = 0
    for _ in range(children):
        least = -scored[0][0][0]
        if len(scored) < 2 or least <= enough or waited >= patience:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[i][1], scored[j][1], sizes, rng)
        if (got := fitness(child)) > scored[-1][0]:
            scored[-1] = (got, child)
            scored.sort(key=lambda x: x[0], reverse=True)
        waited = 0 if -scored[0][0][0] < least else waited + 1
    return [p for _, p in scored]


def first_population(sizes: list[int], capacity: int, n: int, rng: np.random.Generator) -> list[Bins]:
    """Best fit by falling size, and by sizes with more and more noise."""
    base = np.asarray(sizes, dtype=float)
    orders = [np.argsort(-base * np.exp(rng.normal(0, 0.15 * k, len(base))), kind="stable").tolist() for k in range(n)]
    return [best_fit(sizes, o, [], capacity) for o in orders]


def _labels(p: Bins, n: int) -> np.ndarray:
    return p.of(n)


def _packing(labels: np.ndarray, sizes: list[int], capacity: int) -> Bins:
    order, ends = np.argsort(labels, kind="stable").tolist(), np.cumsum(np.bincount(labels)).tolist()
    room = capacity - np.bincount(labels, weights=sizes).astype(np.int64)
    return Bins(capacity, [(order[a:b], r) for a, b, r in zip([0, *ends], ends, room.tolist(), strict=False)])


_ISLAND = "problem long, island int, uids binary, lengths binary, members binary"


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _solved(pieces: DataFrame, problems: int, capacity: int, islands: int, population: int, children: int, migrations: int, seed: int) -> DataFrame:
    """pieces (uid, length) with problem, bin and room, the bin's, in the best packing found. Between
    rounds an island is one row with the bins of all its members, and one for its neighbour with
    those of its best."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        one = (pdf["uid"].to_numpy(np.int64).tobytes(), pdf["length"].to_numpy(np.int64).tobytes(), b"")
        return pd.DataFrame([(int(pdf["problem"].iloc[0]), i, *one) for i in range(islands)], columns=["problem", "island", "uids", "lengths", "members"])

    def island_of(round_: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["uids"].str.len() > 0].iloc[0]
            problem, island, n = int(own["problem"]), int(own["island"]), len(own["uids"]) // 8
            sizes, rng = _numbers(own["lengths"]).tolist(), np.random.default_rng([seed, round_, problem, island])
            labels = np.concatenate([_numbers(m) for m in pdf["members"]]).reshape(-1, n)
            people = [_packing(x, sizes, capacity) for x in labels] or first_population(sizes, capacity, population, rng)
            people = evolve(sizes, capacity, people, children, rng)[:population]
            members = [_labels(p, n).tobytes() for p in people]
            rows = [(problem, island, own["uids"], own["lengths"], b"".join(members))]
            if round_ < migrations and islands > 1:
                rows.append((problem, (island + 1) % islands, b"", b"", members[0]))
            return pd.DataFrame(rows, columns=["problem", "island", "uids", "lengths", "members"])

        return run

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, n = _numbers(pdf["lengths"].iloc[0]).tolist(), len(pdf["uids"].iloc[0]) // 8
        best = max((_packing(_numbers(m)[:n], sizes, capacity) for m in pdf.sort_values("island")["members"]), key=fitness)
        bins = _labels(best, n)
        return pd.DataFrame({"uid": _numbers(pdf["uids"].iloc[0]), "length": sizes, "problem": pdf["problem"].iloc[0], "bin": bins, "room": np.asarray(best.room)[bins]})

    problem = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(problems))
    state = pieces.select("uid", "length", problem.alias("problem")).groupBy("problem").applyInPandas(settle, _ISLAND)
    parts = min(problems * islands, 1 << 14)  # rows are few and small, but work is long: an island each, not as many as fit a partition
    for round_ in range(migrations + 1):
        state = state.repartition(parts, "problem", "island").groupBy("problem", "island").applyInPandas(island_of(round_), _ISLAND)
    return state.groupBy("problem").applyInPandas(choose, "uid long, length long, problem long, bin long, room long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_problem: int = 4096, islands: int = 2, population: int = 5, children: int = 60, migrations: int = 1, poolings: int = 2, spare: float = 0.004) -> DataFrame:
    """pieces with sequence_id and offset. spare: bins with at most this share of room are kept
    before the last of the pooling rounds; problems have about per_problem pieces."""
    spark = pieces.sparkSession
    with batches_of(spark):
        pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("long")})
    open_ = pieces.filter(F.col("length") != capacity).select("uid", "length")
    parts, made = [], 0
    for k in range(poolings + 1):
        n = open_.count()
        if not n:
            break
        problems = max(1, round(n / per_problem))
        more = k < poolings and problems > 1
        done = stored(_solved(open_, problems, capacity, islands, population, children, migrations, k), f"pooling{k}")
        if more:
            good = F.col("room") <= int(spare * capacity)
            parts.append(done.filter(good).withColumn("base", F.lit(made)))
            open_ = done.filter(~good).select("uid", "length")
        else:
            parts.append(done.withColumn("base", F.lit(made)))
            break
        made += problems
    if not parts:
        return full.drop("uid")
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    offsets = chosen.select("uid", (((F.col("base") + F.col("problem")) * (per_problem * 16) + F.col("bin")) * 2).alias("sequence_id"), "length")
    members = offsets.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("members"))
    prefix = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda acc, m: acc + m["length"])
    placed = members.select("sequence_id", "members", F.posexplode("members").alias("at", "m")).select("sequence_id", F.col("m.uid").alias("uid"), prefix.alias("offset"))
    rest = pieces.filter(F.col("length") != capacity).join(placed, "uid")
    return full.unionByName(rest.select(full.columns)).drop("uid")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text), each with its sequence and place there."""
    return pack_pieces(cut_pieces(docs, tokenizer, capacity), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
