"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker while it is held.

In the two kinds of tokenizer recognised here, a run of letters and what is between two runs are
encoded apart, so a text's ids are its parts' ids one after the other. Parts that are runs of
Latin letters go straight to the tokenizer's merges, other parts through all of the tokenizer.
Texts for which that could fail (those with special-token strings or characters on which
white-space definitions differ), and all texts of any other kind of tokenizer, are encoded whole.

For a byte-level tokenizer, the parts of texts of ASCII and Latin letters are found in all of the
texts' bytes at once, and Arrow numbers them, so that only distinct ones become Python's strings."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from operator import attrgetter

import numpy as np
import pyarrow as pa

from fuseline.llm.common import chunked

#: Fixed: characters that Python takes as white space and the tokenizers' patterns don't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
#: Letters whose runs are parts of their own where an ASCII character other than a letter follows.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_RUN = rf"[{LATIN}]+(?=[\s!-@\[-`{{-~]|$)"
#: How texts of either kind of tokenizer fall into parts.
PARTS = {"byte": rf" ?{_RUN}| ?\S+|\s+(?!\S)|\s+", "word": rf"{_RUN}|\S+"}
#: Kinds of bytes: the mark behind each text (no byte of UTF-8), a space, other white space, a Latin letter or
#: half of one, another printable ASCII character, and what only the pattern takes apart.
_END, _SPACE, _BREAK, _LETTER, _OTHER, _ODD = range(6)
_MARK = b"\xff"
#: Bytes of texts whose parts are numbered at once: the more there are, the fewer of them are distinct.
TEXT_BYTES = 1 << 22


def _kinds() -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _OTHER
    out[[b for b in range(0x80) if chr(b).isalpha()]] = _LETTER
    out[[0xC3, *range(0x80, 0xC0)]] = _LETTER
    out[[0x97, 0xB7]] = _ODD  # behind 0xC3 the signs × and ÷
    out[9:14], out[0x20], out[0xFF] = _BREAK, _SPACE, _END
    return out


_KINDS = _kinds()


def part_starts(kinds: np.ndarray) -> np.ndarray:
    """Where the parts of PARTS["byte"] begin in texts of these kinds of bytes without odd ones, each with a
    mark behind it, which is a part as well."""
    solid, end = kinds >= _LETTER, kinds == _END
    white = ~(solid | end)
    after, before = np.append(kinds[1:], _END), np.concatenate(([_END], kinds[:-1]))
    goes_on = after >= _LETTER
    starts = end | (white & goes_on)  # the last of a white run stands with what follows, or alone if it is no space
    starts |= white & ~goes_on & ~((before == _SPACE) | (before == _BREAK))
    starts |= solid & ((before == _END) | (before == _BREAK))
    turns = np.flatnonzero((kinds == _OTHER) & (before == _LETTER))
    runs = np.flatnonzero(solid & (before < _LETTER))
    of = np.searchsorted(runs, turns, side="right") - 1
    first = np.append(True, of[1:] != of[:-1])[: len(of)]  # a run that begins with letters is cut where these end
    starts[turns[first & (kinds[runs[of]] == _LETTER)]] = True
    return np.flatnonzero(starts)


class Known(dict):
    """Parts of texts with their ids; one that isn't held is taken from older or learnt."""

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]):
        self.learn, self.older = learn, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        self[word] = ids = self.learn(word) if ids is None else ids
        return ids


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    limit: words kept, in two halves. When the newer one is full it becomes the older one, from which
    words in use come back, and what the older one had is forgotten."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._set(Tokenizer.from_file(path), _kind(spec), [t["content"] for t in spec.get("added_tokens") or []], limit)

    @classmethod
    def of(cls, tokenizer, kind: str | None, limit: int = 1_000_000) -> Encoder:
        """For a tokenizer of the given kind that has no special tokens."""
        out = cls.__new__(cls)
        out._set(tokenizer, kind, [], limit)
        return out

    def _set(self, tokenizer, kind: str | None, special: list[str], limit: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind, self.limit, self.known = tokenizer, kind, limit, Known(self._learn, {})
        self.find = re.compile(PARTS[kind]).findall if kind else None
        self.odd = special + list(ODD_SPACE)
        self.letters = re.compile(f" ?[{LATIN}]+").fullmatch
        self.merges, self.ids = tokenizer.model.tokenize, attrgetter("id")
        letters = byte_letters()
        self.bytes, self.space = str.maketrans(letters), letters[" "]

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # the usual case of what follows
            plain = self.space + word[1:] if word[0] == " " else word
        else:
            plain = word.encode().decode("latin-1").translate(self.bytes) if self.letters(word) else None
        if plain is None or self.kind == "word" and not word.islower():
            return self._fresh([word])[0]
        return array("I", map(self.ids, self.merges(plain))).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Long texts are taken in parts that end at a single space, so that few words are held."""
        parts = [self._parts(t) for t in texts]
        if all(len(p) == 1 for p in parts):
            return self._encode(texts)
        return [b"".join(b for x in p for b in self._encode([x])) for p in parts]

    def _parts(self, text: str, size: int = 1 << 20) -> list[str]:
        if len(text) <= 2 * size or self.find is None or any(x in text for x in self.odd):
            return [text]
        out, start = [], 0
        while (cut := text.find(" ", start + size)) >= 0:
            while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[start:cut])
            start = cut
        return [*out, text[start:]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.find is None or any(x in t for x in self.odd)]
        for i, ids in zip(whole, self._fresh([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if self.kind == "byte":
            rest = [i for i, x in enumerate(out) if x is None]
            for first, part in chunked([texts[i] for i in rest], TEXT_BYTES):
                for i, ids in zip(rest[first : first + len(part)], self._by_bytes(part), strict=True):
                    out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                self._turn()
                words = self.find(t.lower() if self.kind == "word" and _narrow(t) else t)
                out[i] = b"".join(map(self.known.__getitem__, words))
        return out

    def _turn(self) -> None:
        if len(self.known) > self.limit // 2:
            older = self.known
            older.older = {}
            self.known = Known(self._learn, older)

    def _by_bytes(self, texts: list[str]) -> list[bytes | None]:
        """None for texts that only the pattern takes apart."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        plain = range(len(raw))
        while True:
            buf = np.frombuffer(b"".join([raw[i] + _MARK for i in plain]), np.uint8)
            kinds = _KINDS[buf]
            odd = np.flatnonzero(kinds == _ODD)
            if not len(odd):
                break
            lost = set(np.searchsorted(np.flatnonzero(kinds == _END), odd).tolist())
            plain = [i for k, i in enumerate(plain) if k not in lost]
        out: list[bytes | None] = [None] * len(texts)
        if not len(buf) or len(buf) > 1 << 28:  # ids of more would not fit Arrow's arrays
            return out
        self._turn()
        starts = part_starts(kinds)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(buf)]).dictionary_encode()
        ids = pa.array([b"" if w == _MARK else self.known[w.decode()] for w in parts.dictionary.to_numpy(zero_copy_only=False)], pa.binary()).take(parts.indices)
        _, ends, data = ids.buffers()
        data = memoryview(data or b"")
        edges = np.frombuffer(ends, np.int32)[np.flatnonzero(kinds[starts] == _END)].tolist()
        for i, a, b in zip(plain, [0, *edges], edges, strict=False):
            out[i] = bytes(data[a:b])
        return out


def _narrow(text: str) -> bool:
    """Whether all characters are Latin-1: their lower case doesn't hang on neighbours."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> dict[str, str]:
    """The letter that byte-level tokenizers write for each byte (here a Latin-1 character):
    printable ones stand for themselves, the others take the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(0x100 + k) for k, b in enumerate(other)}


def _kind(spec: dict) -> str | None:
    """"byte" (byte level, a space belongs to the next word), "word" (white space dropped, lower
    case), or None for a tokenizer of another form."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = (norm or {}).get("normalizers", [])
    first = (pre.get("pretokenizers") or [{}])[0]
    spaces = any(s["type"] == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    if spaces and {s["type"] for s in steps} == {"NFC", "Lowercase", "Replace"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return "word"
    return None
