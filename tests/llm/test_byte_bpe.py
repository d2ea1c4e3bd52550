"""Byte-level BPE against the library that the ranks are meant for."""

from __future__ import annotations

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from fuseline.llm import byte_bpe
from fuseline.llm.tokens import tokenizer_path

PATHS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def plain(name: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=byte_bpe.public_pattern(), mergeable_ranks=byte_bpe.read_ranks(tokenizer_path(name)), special_tokens={})


def codec(name: str) -> byte_bpe.ByteBpe:
    return byte_bpe.codec(tokenizer_path(name), byte_bpe.public_pattern())


ODD = ["", " ", "  \n\t ", "a" * 700, "ab" * 3000, "-=" * 900, " " * 5000 + "x", "don't we'LL I'd", "<|endoftext|>", "中文 あいう 한국어", "🙂👩‍👩‍👧 é é ß İ", "\x00\x1c\x1d\x85\xa0 　x", "\U0010ffff͸", "½ ² ٣ Ⅷ 12345678901234567890"]


@pytest.mark.parametrize("name", PATHS)
def test_ids_are_those_of_the_ranks(name):
    rng = random.Random(5)
    letters = "aab  \n\t'sdlre1 23-=_.,éüß中文あ🙂́"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)]
    bpe, want = codec(name), plain(name).encode_ordinary_batch(texts)
    got = bpe.encode(texts)
    assert [x.tolist() for x in got] == want
    assert all(bpe.decode(x) == t.encode() for x, t in zip(want, texts, strict=True))
    assert all("".join(bpe.decode_each(x)) == t for x, t in zip(want, texts, strict=True))


def test_all_code_points():
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}! {chr(c)} " for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in codec(PATHS[0]).encode(texts)] == plain(PATHS[0]).encode_ordinary_batch(texts)


def test_offsets():
    bpe = codec(PATHS[0])
    for text in ODD + ["naïve 🙂 façade"]:
        ids, at = bpe.encode_offsets([text])[0]
        assert ids.tolist() == bpe.encode([text])[0].tolist() and len(at) == len(ids)
        covered = set()
        for i, (a, b) in zip(ids.tolist(), at.tolist(), strict=True):
            raw = bpe.bytes[i]
            assert raw in text[a:b].encode() and (text[a:b].encode() == raw or b - a <= len(raw))
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))


def test_split_characters():
    bpe = codec(PATHS[0])
    ids = bpe.encode(["\U0010ffff"])[0].tolist()
    assert len(ids) > 1
    assert bpe.decode_each(ids) == [""] * (len(ids) - 1) + ["\U0010ffff"]
    assert bpe.decode_each(ids[:-1])[-1] == "�" and bpe.decode_each([]) == []


def test_long_texts_in_parts():
    rng = random.Random(3)
    text = "".join(rng.choice(["word", "don't", " ", "  ", "\n", "12", "é中", "!?", " a"]) for _ in range(60_000))
    ranks = plain(PATHS[0])
    want = ranks.encode_ordinary(text)
    for size in (10, 1000, byte_bpe.PART):
        parts = list(byte_bpe.cut_at_spaces(text, size))
        assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p for a, p in parts)
        assert [i for _, p in parts for i in ranks.encode_ordinary(p)] == want
    long = text * 30
    ids, at = codec(PATHS[0]).encode_offsets([long])[0]
    assert ids.tolist() == codec(PATHS[0]).encode([long])[0].tolist() == ranks.encode_ordinary(long)
    assert "".join(long[a:b] for a, b in dict.fromkeys(map(tuple, at.tolist()))) == long


def test_another_pattern():
    """Digits one by one: what is safe to cut with the public pattern isn't with every other."""
    pattern = r"\p{N}|[^\p{N}]+"
    other = tiktoken.Encoding("digits", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(tokenizer_path(PATHS[0])), special_tokens={})
    texts = ["one two 1234 three  four", *ODD]
    assert [x.tolist() for x in byte_bpe.codec(tokenizer_path(PATHS[0]), pattern).encode(texts)] == other.encode_ordinary_batch(texts)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_query(spark, data):
    got = {r["doc_id"]: r for r in byte_bpe.op11_byte_bpe(spark, data).collect()}
    docs, encode = spark.read.parquet(f"{data}/documents.parquet").collect(), plain(PATHS[0]).encode_ordinary
    assert len(got) == len(docs)
    for r in docs:
        ids, x = encode(r["text"] or ""), got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha((r["text"] or "").encode()))


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "same é"), (3, "same é"), (None, "no id 🙂"), (4, "y " * 700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS starts", "'x' AS texts")
    path = tokenizer_path(PATHS[0])
    coded = byte_bpe.encode_texts(docs, path, offsets=True, decoded=True)
    out = coded.collect()
    assert coded.columns == ["doc_id", "ids", "starts", "ends", "decoded"] and len(out) == 6
    want = sorted((str(d), (t or "").encode()) for d, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in out) == want
    back = byte_bpe.decode_ids(coded, path, each=True).collect()
    assert sorted((str(r["doc_id"]), r["text"].encode()) for r in back) == want
    assert all("".join(r["texts"]) == r["text"] and len(r["texts"]) == len(r["ids"]) for r in back)
    assert byte_bpe.encode_texts(docs.filter("false"), path).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_bpe.decode_ids(none, path).select("text", F.length("decoded").alias("n")).collect() == [("", 0)]
