"""Operator 11: byte-level BPE encoding and decoding by a file of ranks.

The ranks (each token's bytes in base 64 and its id, the lower the earlier it is merged) become a model of the
tokenizers library: each byte is written as a letter, and a token's merge is the last one that the ranks make
when they are applied to the token's own bytes. What joins the bytes of a token inside a longer match never
crosses the token's ends, so it is the same there, and one merge a token gives the ids that trying all neighbours
against the ranks would give. A match that is a token itself is taken whole. Decoding goes back from letters to bytes.

Texts are encoded in Arrow batches, few at a time, and a long text in parts that end before a single space between
two other characters, where a match of the public pattern ends in any case, so a worker holds the encoding of few characters however
long a text is. For the same reason each distinct part between such places is encoded once in a worker. With another pattern texts are
encoded whole. Offsets count code points; a token that is part of a character has that whole character's, and a character that
is split between tokens is decoded with the last of them.

Defined cases: a null text counts as empty and gives no ids, an empty digest's text and no bytes; strings of special tokens are ordinary
text; rows that repeat, share a doc_id or have none are treated each on its own; an empty table gives no rows; further columns are ignored.
Ids that are null or not in the file are an error when decoded; a null list of ids decodes to no bytes."""

from __future__ import annotations

import base64
import codecs
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import pieces, table, text_or_empty
from fuseline.llm.tokens import Encoder, byte_letters, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
PART = 1 << 19


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the ranks join last when they make the token, None if they don't make it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """encode() and decode() by a file of ranks and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        ranks, letters = read_ranks(path), byte_letters()
        as_letters = lambda b: b.decode("latin-1").translate(to_letter)
        to_letter = str.maketrans(letters)
        order = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
        merges = [tuple(map(as_letters, m)) for m in (last_merge(t, ranks) for t in order) if m]
        self.tokenizer = Tokenizer(BPE({as_letters(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts = pattern == public_pattern()
        self.encoder = Encoder.of(self.tokenizer, "byte" if self.parts else None)
        from_letter = str.maketrans({v: k for k, v in letters.items()})
        self.bytes = {i: t.translate(from_letter).encode("latin-1") for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        return [np.frombuffer(ids, "<u4").astype(np.int32) for ids in self.encoder.encode(texts)]

    def encode_offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids and their code points, a row (start, end) for each id."""
        return [tuple(map(np.concatenate, zip(*self._long(t), strict=True))) for t in texts]

    def _long(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start, part in cut_at_spaces(text) if self.parts else [(0, text)]:
            found = self.tokenizer.encode(part, add_special_tokens=False)
            yield np.array(found.ids, np.int32), np.array(found.offsets, np.int32).reshape(-1, 2) + start

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_each(self, ids: list[int]) -> list[str]:
        """Each token's text. A character split between tokens stands with the last of them; bytes that
        are no character become U+FFFD."""
        if not len(ids):
            return []
        read = codecs.getincrementaldecoder("utf-8")("replace").decode
        out = [read(self.bytes[i]) for i in ids]
        out[-1] += read(b"", final=True)
        return out


def cut_at_spaces(text: str, size: int = PART) -> Iterator[tuple[int, str]]:
    """(start, part) of a text cut before single spaces between two other characters, about every size characters."""
    start = 0
    while len(text) - start > 2 * size:
        cut = text.find(" ", start + size)
        while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One per Python worker; it lasts over the worker's tasks."""
    return ByteBpe(path, pattern)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, rows[0].dtype)]), kind))


def encode_texts(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of docs (doc_id, text); with offsets also starts and ends, the code points
    of each id; with decoded also the bytes that the ids decode to."""
    pattern = pattern or public_pattern()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for first, part in pieces(batch.column("text")):
                out = {"doc_id": batch.column("doc_id").slice(first, len(part))}
                if offsets:
                    found = bpe.encode_offsets(part)
                    ids = [x for x, _ in found]
                else:
                    ids = bpe.encode(part)
                out["ids"] = _lists(ids, pa.int32())
                if offsets:
                    out |= {"starts": _lists([x[:, 0] for _, x in found], pa.int32()), "ends": _lists([x[:, 1] for _, x in found], pa.int32())}
                if decoded:
                    out["decoded"] = pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(encode, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded)


def decode_ids(encoded: DataFrame, path: str, pattern: str | None = None, each: bool = False) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the ids' bytes, and text, those as UTF-8 with U+FFFD for bytes that
    are no character; with each also texts, what every id adds to the text."""
    pattern = pattern or public_pattern()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column("ids").slice(at, 256)
                lists = ids.to_pylist()
                raw = [bpe.decode(x) for x in lists]
                out = {"doc_id": batch.column("doc_id").slice(at, 256), "ids": ids, "decoded": pa.array(raw, pa.binary()), "text": pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())}
                if each:
                    out["texts"] = pa.array([bpe.decode_each(x) for x in lists], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(encoded.dtypes)["doc_id"]
    return rows.mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded binary, text string" + ", texts array<string>" * each)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
