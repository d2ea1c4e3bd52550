"""Operator 2: token-id files of bit-plane shuffled, compressed blocks with a chunk index.

A shard file holds the ids of a range of documents, one after the other in ascending doc_id
order. The ids are cut into blocks of a fixed number of ids (the last may be shorter); a block
is transposed into byte planes (plane k: byte k of every id) or bit planes, only as many as its
largest id needs, and each plane is a zstandard frame. Between blocks stand lists of the documents so far, each
of a fixed number of documents with their numbers of ids. The chunk index at the end says where
each block starts, how many planes it has and how long each is, and where the lists are, so that a
reader can fetch any block or document alone.

    MAGIC | frames of blocks and lists | zstandard frame of the index | its length, 8 bytes | MAGIC

There are as many shards as shuffle partitions, and more where a shard would hold over SHARD_BYTES of
text. A writer or reader holds one block and one list, however long its shard is.

Defined cases: a null text counts as empty (one id, the end id); rows that repeat a doc_id are
kept, by the text's hash, and may fill several shards; rows with a null doc_id come first; an empty table gives no documents; further
columns are ignored. Shards are named by task attempt and only those that the manifest lists
count, so a lost or repeated task leaves nothing that is read."""

from __future__ import annotations

import functools
import json
import math
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuseline.llm.common import batches_of, pieces, scratch_dir, stored, text_or_empty
from fuseline.llm.tokens import Encoder, tokenizer_path

MAGIC = b"FLPLANE1"
BLOCK = LISTED = 1 << 16
SHARD_BYTES = 1 << 28
END_ID = 2
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; it lasts over the worker's tasks."""
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """A block's planes, the lowest first."""
    bits = max(1, int(ids.max()).bit_length())
    width = -(-bits // 8)
    low = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(low.T)]
    flat = np.unpackbits(low, axis=1, bitorder="little")[:, :bits]
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    grid = np.frombuffer(b"".join(planes), dtype=np.uint8).reshape(len(planes), -1)
    out = np.zeros((n, 4), dtype=np.uint8)
    if kind == "byte":
        out[:, : len(planes)] = grid.T
    else:
        flat = np.unpackbits(grid, axis=1, bitorder="little", count=n).T
        low = np.packbits(flat, axis=1, bitorder="little")
        out[:, : low.shape[1]] = low
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Takes the ids of whole documents in order; holds one block of ids and one list of documents."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, listed: int = LISTED, level: int = 1):
        import zstandard

        self.sink, self.kind, self.block, self.listed = sink, kind, block, listed
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.left, self.n_docs, self.n_tokens = 0, bytearray(), 0, 0
        self.blocks: list[list[int]] = []
        self.lists: list[list[int]] = []
        self.names, self.counts, self.nulls = array("q"), array("Q"), 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Documents without doc_id come first."""
        self.nulls += doc_id is None
        self.names.append(doc_id or 0)
        self.counts.append(len(ids) // 4)
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids) // 4
        self.left += ids
        size = 4 * self.block
        while len(self.left) >= size:
            self._put(bytes(self.left[:size]))
            del self.left[:size]
        if len(self.names) == self.listed:
            self._list()

    def _put(self, ids: bytes) -> None:
        frames = [self.pack(p) for p in to_planes(np.frombuffer(ids, dtype="<u4"), self.kind)]
        self.blocks.append([self.at, len(ids) // 4, *map(len, frames)])
        self._write(b"".join(frames))

    def _list(self) -> None:
        frame = self.pack(np.array(self.names, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self.lists.append([self.at, len(self.names), self.nulls, len(frame)])
        self._write(frame)
        self.names, self.counts, self.nulls = array("q"), array("Q"), 0

    def close(self) -> int:
        """The file's size."""
        if self.left:
            self._put(bytes(self.left))
        if self.names:
            self._list()
        index = self.pack(json.dumps({"kind": self.kind, "blocks": self.blocks, "lists": self.lists}).encode())
        self._write(index + struct.pack("<Q", len(index)) + MAGIC)
        return self.at


def read_index(source) -> dict:
    """The chunk index of an open shard file."""
    import zstandard

    size = source.size()
    source.seek(size - 8 - len(MAGIC))
    tail = source.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a shard file")
    (n,) = struct.unpack("<Q", tail[:8])
    source.seek(size - 8 - len(MAGIC) - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_block(source, entry: list[int], kind: str) -> np.ndarray:
    import zstandard

    at, n, *sizes = entry
    source.seek(at)
    data, planes, unpack = source.read(sum(sizes)), [], zstandard.ZstdDecompressor().decompress
    for size in sizes:
        planes.append(unpack(data[:size]))
        data = data[size:]
    return from_planes(planes, n, kind)


def read_documents(source) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids of the shard's documents before it, ids) of each document; holds one block,
    one list and one document."""
    import zstandard

    index = read_index(source)
    held, start, blocks = bytearray(), 0, iter(index["blocks"])
    for at, n, nulls, size in index["lists"]:
        source.seek(at)
        names, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size)), "<i8").reshape(2, n).tolist()
        for k, (name, count) in enumerate(zip(names, counts, strict=True)):
            while len(held) < 4 * count:
                held += read_block(source, next(blocks), index["kind"]).tobytes()
            yield None if k < nulls else name, start, bytes(held[: 4 * count])
            del held[: 4 * count]
            start += count


def filesystem(uri: str):
    """pyarrow's file system for a URI that all executors reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_token_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, kind: str = "byte", block: int = BLOCK, listed: int = LISTED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs (doc_id, text) and write shard files below the URI out, one for each range
    of doc_id. Returns the manifest, a row for each shard in the documents' order."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / shard_bytes))
    order = ["doc_id", "h", "row"]
    ranged = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = filesystem(out)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.planes"
        encode = encoder(tokenizer).encode
        with store.open_output_stream(name) as sink:
            writer = ShardWriter(sink, kind, block, listed)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, part in pieces(batch.column("text")):
                    for doc_id, got in zip(ids[first : first + len(part)], encode(part), strict=True):
                        writer.add(doc_id, got + end)
            size = writer.close()
        if writer.n_docs:
            path = out.rstrip("/") + name[len(folder) :]
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))
        else:
            store.delete_file(name)

    with batches_of(spark):
        return stored(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_token_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document of the shards: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and its ids as little-endian 32-bit integers if with_ids."""
    shards = manifest.withColumn("before", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    shards = shards.select("path", F.coalesce("before", F.lit(0)).alias("before"))
    shards = shards.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(k).to_pylist() for k in ("path", "before")), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as source:
                    held: list[tuple] = []
                    size = 0
                    for doc_id, start, ids in read_documents(source):
                        held.append((doc_id, before + start, len(ids) // 4, zlib.crc32(ids), ids)[: len(kinds)])
                        size += len(ids) if with_ids else 40
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], schema=pa.schema(kinds))
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_shards(docs, scratch_dir(spark), tokenizer_path("word_bpe_49k.json"))
    return read_token_shards(manifest, with_ids=False)
