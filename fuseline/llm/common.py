"""What the operators of this folder share: reading, Arrow batches, word and shingle arrays."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.sources.scratch import scratch_dir, stored

__all__ = ["WORD", "WORD_RE", "batches_of", "chunked", "gathered", "grouped", "hash_words", "joined", "matrix", "mix64", "pieces", "scratch_dir", "shingle_sets", "stored", "table", "text_or_empty", "word_hashes"]

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of few rows for what is written inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def chunked(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of neighbours that together have about limit characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of neighbours of an Arrow array that together have about limit bytes, so
    that a Python worker holds few whole texts at a time, however many rows a batch has."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Neighbouring batches that together have limit bytes, or all that are left; holds one batch more than that at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by the keys; holds a key's rows and a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if last is not None and tuple(key[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(key[-1])
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _FOLD
    x = x ^ (x >> np.uint64(32))
    x = x * _FOLD
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


_BASE = 0xB492B66FBE98F273
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, index in it of each text's first word, with
    the total at the end).

    A word's hash is its UTF-8 bytes as a polynomial modulo 2**64, taken from running sums
    over the joined texts, then mixed."""
    return hash_words(*joined(texts))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, each followed by a new line, and where each ends."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    return buf, np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)


def hash_words(buf: np.ndarray, ends: np.ndarray, limit: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of joined() texts. A long buffer is taken in parts cut at white space, so that
    the running sums are short; only a word longer than limit makes a longer part."""
    parts, firsts, start = [], [], 0
    while start < len(buf):
        stop = min(start + limit, len(buf))
        while stop < len(buf):
            blanks = np.flatnonzero(_spaces(buf[start:stop]))
            if len(blanks):
                stop = start + int(blanks[-1]) + 1
                break
            stop = min(stop + limit, len(buf))
        hashes, first = _hash_part(buf[start:stop])
        parts.append(hashes)
        firsts.append(first + start)
        start = stop
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.searchsorted(np.concatenate(firsts), ends)))


def _spaces(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _hash_part(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a buffer."""
    inner = ~_spaces(buf)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inner, [False])).view(np.int8)))
    first, last = edge[0::2], edge[1::2]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf), _BASE), out=total[1:])
    shift = _powers(len(buf), _INVERSE)[first] if len(first) else np.zeros(0, np.uint64)
    return mix64((total[last] - total[first]) * shift + (last - first).astype(np.uint64) * _MULT), first


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of runs of so many words. A text with fewer
    words has one shingle of all its words; one without words has none."""
    out: list[np.ndarray] = []
    for _, part in chunked(texts):
        hashes, bounds = word_hashes(part)
        grams, n = hashes.copy(), len(hashes)
        for k in range(1, min(words, n)):
            grams[: n - k] = mix64(grams[: n - k] * _MULT + hashes[k:])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                one = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    one = mix64(one * _MULT + hashes[k : k + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
