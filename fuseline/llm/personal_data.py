"""Operator 5: personal data by boosted trees over candidate spans.

Base spans of four kinds are found by pattern and check alone and always stay. Beside them,
generators of high recall propose overlapping candidates: every run of digit groups within longer
runs, up to 19 digits, numbers without the plus, cards and addresses with other separators, written-out or bracketed
"at" and "dot". Boosted trees score each candidate from its form (digits, groups, separators,
checksum, prefix) and context (the characters and words beside it); a threshold for each kind,
calibrated on examples the trees were not fitted to, selects. Selected candidates that overlap
no base span are added, the likeliest first, none of them overlapping another.

The trees are fitted, in one task, to the candidates in EXAMPLES generated sentences with fixed seeds, since
no table marks personal data: numbers and addresses in the forms in which people write them, and what is
mistaken for them: dates, prices, versions, measures, hexadecimal tokens, parts of longer numbers.

Defined cases: a null or empty text has no spans; positions are code points, the end not included;
rows that repeat are searched each; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import bisect
import functools
import hashlib
import pickle
import random
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.boosting import Trees, boost
from fuseline.llm.common import pieces, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, SEED, PRECISION = 4000, 7, 0.995
#: Fixed: the base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does; tried elsewhere, a long run takes the square of its length.
_IP = re.compile("(?<![0-9])" + BASE["ip"].pattern)


def _emails(text: str) -> list[tuple[int, int]]:
    """BASE["email"]'s matches, found from each @, so that long runs of letters cost nothing."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for k, pattern in ((1, _IP), (2, BASE["card"]), (3, BASE["phone"])):
        if k != 3 or "+" in text:
            out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _passes(KINDS[k], m.group())]
    return out


_AT = r"\s?(?:\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<\s?at\s?>|\[\s?@\s?\]|\(\s?@\s?\)|\sat\s|@)\s?"
_DOT = r"(?:\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|<\s?dot\s?>|\[\.\]|\(\.\))\s?|\sdot\s|\.)"
WRITTEN = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
HINT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]|\sdot\s|[\[({<]\s?dot\s?[\])}>]", re.I)
#: A written-out "at" before a dotted name. WRITTEN matches no text without an @, HINT or this.
PLAIN = re.compile(rf"\sat\s\s?[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]", re.I)
RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20\xa0()./‐-―-]{0,3}[0-9])+")
GROUP = re.compile(r"[0-9]+")
MOST_DIGITS = 19


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: set[Span] = set()
    if "@" in text or HINT.search(text) or PLAIN.search(text):
        out.update((0, m.start(), m.end()) for m in WRITTEN.finditer(text))
    if _DIGIT.search(text) is None:
        return sorted(out)
    for run in RUN.finditer(text):
        groups = [(m.start(), m.end()) for m in GROUP.finditer(text, run.start(), run.end())]
        for i, (a, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                b = groups[j][1]
                if digits > MOST_DIGITS:
                    break
                if j == i + 3 and text[a:b].count(".") == 3:
                    out.add((1, a, b))
                if 12 <= digits <= MOST_DIGITS:
                    out.add((2, a, b))
                if 7 <= digits <= 15:
                    start = a
                    while start > run.start() and text[start - 1] in "+(":
                        start -= 1
                    out.add((3, start, b))
    return sorted(out)


#: Fixed: words beside personal data of each kind, in the languages of the tables.
CUES = (("mail", "contact", "correo", "kontakt"), ("ip", "host", "server", "address", "adresse"), ("card", "visa", "karte", "carte", "tarjeta", "kredit"), ("phone", "tel", "call", "fax", "mobile", "telefon", "ruf"))
FEATURES = 26


def describe(text: str, span: Span) -> list[float]:
    """The span's form and context as FEATURES numbers."""
    kind, a, b = span
    body, before, after = text[a:b], text[a - 1 : a] if a else " ", text[b : b + 1] or " "
    groups = GROUP.findall(body)
    digits = "".join(groups)
    lengths = [len(g) for g in groups] or [0]
    near = text[max(0, a - 24) : a].lower()
    return [
        kind, b - a, len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
        body.startswith("+"), body.count("("), body.count("."), body.count("-"), body.count(" "), body.count("/"),
        luhn(digits) if 12 <= len(digits) <= 19 else -1, int(digits[:1] or 0), max([int(g[:4]) for g in groups], default=0),
        before.isalnum(), after.isalnum(), before in "+-./,$€£#=\"'(", after in "-./,%€$°=\"'" and text[b + 1 : b + 2].isalnum(),
        text[max(0, a - 2) : a].strip()[-1:].isdigit(), text[b : b + 2].strip()[:1].isdigit(),
        any(c in near for c in CUES[kind]), bool(HINT.search(body)) + 2 * ("@" in body), len(set(re.sub("[0-9]+", "", body))),
    ]


class Detector(NamedTuple):
    trees: Trees
    thresholds: tuple[float, ...]


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated text and the personal data in it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "the", "re", "tion", "er", "ou", "in", "es", "que", "de"]) for _ in range(rng.randint(1, 3)))
    text, spans = "", []

    def add(s: str, kind: int | None = None) -> None:
        nonlocal text
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice([14, 14, 14, 13]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join([d[:4], d[4:8], d[8:12], d[12:]]) if sep else d

    def phone() -> str:
        form = rng.choice(["+1 (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "+dd ddd ddddddd", "00dd dd ddddddd", "+dd d dd dd dd dd", "0d dd dd dd dd", "0ddd/ddddddd", "0ddd ddddddd", "+dd.ddd.ddd.ddd", "1-ddd-ddd-dddd"])
        return re.sub("d", lambda _: digits(1), form)

    def email() -> str:
        at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", "@", "@"])
        dot = rng.choice([" [dot] ", "[dot]", " (dot) ", "(dot)", " dot "]) if at != "@" else rng.choice([".", " dot ", "[.]", "."])
        return word() + rng.choice(["", "." + word(), digits(2)]) + at + word() + rng.choice(["", dot + word()]) + dot + rng.choice(["com", "org", "net", "de", "fr"])

    def other() -> str:
        form = rng.choice(["dddd-dd-dd", "dd.dd.dddd", "dd/dd/dddd", "d.d.d.dddd", "d.dd.d", "$d,ddd.dd", "dddd", "ddddd", "dd%", "dddd-dddd", "dd:dd:dd", "ddd-d-dd-dddddd-d", "#dddddddd", "dddddddddd", "ddd.dddd", "d ddd ddd", "dd ddd", "dddddddddddddddd", "ddd.ddd.ddd.ddd.ddd", "No. dddddd-dd", "dddd dddd", "20dd-20dd", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"])
        return re.sub("h", lambda _: rng.choice("0123456789abcdef"), re.sub("(?<!o)d", lambda _: digits(1), form))

    for _ in range(rng.randint(2, 5)):
        add(" ".join(word() for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ". ", ": ", ", "]))
        kind = rng.choice([0, 1, 2, 3, 3, None, None, None])
        if kind is not None and rng.random() < 0.5:
            add(rng.choice(CUES[kind]) + rng.choice([" ", ": ", " no. "]))
        if kind == 1:
            add(".".join(str(rng.randint(0, 255)) for _ in range(4)), 1)
            add(rng.choice(["", "", ":8080", "/24"]))
        elif kind is None:
            add(other())
        else:
            add((email, None, card, phone)[kind](), kind)
            if kind == 3 and rng.random() < 0.3:
                add(" ")
                add(".".join(str(rng.randint(1, 255)) for _ in range(4)), 1)
        add(rng.choice([" ", " ", ". ", ", ", "\n", "!! "]))
    return text + word(), spans


def examples(numbers: range, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, whether it is personal data, number of its sentence) of each candidate in the
    sentences of these numbers. The features hold the kind first."""
    x, y, of = [], [], []
    for k in numbers:
        text, spans = _sentence(random.Random(seed * 1_000_003 + k))
        for c in candidates(text):
            x.append(describe(text, c))
            y.append(c in spans)
            of.append(k)
    return np.array(x, float).reshape(-1, FEATURES), np.array(y, bool), np.array(of, int)


def fit(x: np.ndarray, y: np.ndarray, of: np.ndarray, precision: float = PRECISION) -> Detector:
    """Fitted to three of four sentences; each kind's threshold is the least at which so large a
    share of the selected candidates of the other sentences is right."""
    part = of % 4 == 3
    trees = boost(x[~part], y[~part])
    p, thresholds = trees.probability(x[part]), []
    for kind in range(len(KINDS)):
        mine = x[part][:, 0] == kind
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[part][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds.append(max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.1)
    return Detector(trees, tuple(thresholds))


@functools.lru_cache(maxsize=2)
def detector(spark: SparkSession, sentences: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> Detector:
    """The detector; tasks make the examples, and one of their bounded number fits the trees."""
    step = -(-sentences // 16)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, of = examples(range(int(pdf["id"].iloc[0]) * step, min(sentences, (int(pdf["id"].iloc[0]) + 1) * step)), seed)
        return pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "k": [of.tobytes()], "id": pdf["id"].iloc[:1].tolist()})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y, of = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("x", float), ("y", bool), ("k", int)))
        return pd.DataFrame({"model": [pickle.dumps(fit(x.reshape(-1, FEATURES), y, of, precision))]})

    made = spark.range(16).groupBy("id").applyInPandas(make, "x binary, y binary, k binary, id long")
    return pickle.loads(made.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "model binary").first()[0])


class _Taken:
    """Disjoint intervals; hit() says whether one overlaps any of them."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def hit(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def find_spans(texts: list[str], model: Detector) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    taken = [_Taken(b) for b in base]
    rows = [(i, c) for i, t in enumerate(texts) for c in candidates(t) if not taken[i].hit(c[1], c[2])]
    added: list[list[Span]] = [[] for _ in texts]
    if rows:
        p = model.trees.probability(np.array([describe(texts[i], c) for i, c in rows], float))
        for k in np.argsort(-p, kind="stable"):
            i, c = rows[k]
            if p[k] >= model.thresholds[c[0]] and not taken[i].hit(c[1], c[2]):
                added[i].append(c)
                taken[i].add(c[1], c[2])
    return list(zip(base, added, strict=True))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping ones the first, the
    longest of those from one place."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, the base spans' numbers by kind and digest, all spans, and the number of those that
    were added, of each row of docs (doc_id, text); with_text: the redacted text as well."""
    model = detector(docs.sparkSession)
    shape = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())] + [("redacted", pa.string())] * with_text

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * with_text)
    def find(text: pa.Array) -> pa.Array:
        out = []
        for _, texts in pieces(text):
            for t, (base, added) in zip(texts, find_spans(texts, model), strict=True):
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                row = (*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added), len(added))
                out.append((*row, redact(t, base + added)) if with_text else row)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(shape)], names=[n for n, _ in shape])

    return docs.select("doc_id", find(text_or_empty()).alias("f")).select("doc_id", "f.*")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
