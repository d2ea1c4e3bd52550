"""Values out of careless texts: lenient JSON, shortened texts, digits, smart types."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_WORDS = {"null": None, "none": None, "nan": None, "true": True, "false": False}
_TOKEN = re.compile(r"\s*(?:(?P<mark>[{}\[\]:,])|(?P<quote>[\"'])|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?=[\s,:}\]]|$)|(?P<word>[^\s{}\[\]:,\"']+))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class _Reader:
    """Reads a value from a text that may lack closing marks and quotes, or have extra commas."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def token(self) -> tuple[str, object]:
        found = _TOKEN.match(self.text, self.at)
        if not found:
            self.at = len(self.text)
            return "end", None
        self.at = found.end()
        kind = found.lastgroup
        if kind == "quote":
            return "value", self.string(found["quote"])
        if kind == "number":
            return "value", json.loads(re.sub(r"^(-?)0+(?=\d)", r"\1", found["number"]))
        if kind == "word":
            return "word", found["word"]
        return kind, found["mark"]

    def string(self, quote: str) -> str:
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                e = self.text[self.at]
                self.at += 1
                code = self.text[self.at : self.at + 4] if e == "u" else ""
                if re.fullmatch("[0-9a-fA-F]{4}", code):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(e, e))
            elif c == quote and (quote == '"' or re.match(r"\s*(?:[:,}\]]|$)", self.text[self.at : self.at + 40])):
                break  # an apostrophe inside a word doesn't close
            else:
                out.append(c)
        return "".join(out)

    def value(self, depth: int = 0):
        """The next value; open ones are kept on a stack, so that deep nesting is no recursion."""
        stack: list[tuple[object, object]] = []  # (dict or list, key that waits for its value)
        while True:
            kind, got = self.token()
            done, result = False, None
            if kind == "end":
                while len(stack) > 1:
                    self._put(stack, stack.pop()[0])
                if not stack:
                    raise ValueError("no value")
                return stack[0][0]
            if kind == "mark" and got in "{[":
                stack.append(({} if got == "{" else [], None))
            elif kind == "mark" and got in "}]" and stack:
                done, result = True, stack.pop()[0]
            elif kind in ("value", "word"):
                whole = stack and isinstance(stack[-1][0], dict) and stack[-1][1] is None
                if whole:
                    stack[-1] = (stack[-1][0], str(got))  # a key
                else:
                    done, result = True, _WORDS.get(str(got).lower(), got) if kind == "word" else got
            if done:
                if not stack:
                    return result
                self._put(stack, result)

    @staticmethod
    def _put(stack: list, value) -> None:
        top, key = stack[-1]
        if isinstance(top, list):
            top.append(value)
        elif key is not None:
            top[key] = value
            stack[-1] = (top, None)


def read_lenient(text: str | None):
    """The JSON value in a text: all of it, what stands in a fence, or from its first brace or bracket on,
    with quotes, commas and closing marks mended. ValueError if there is none."""
    body = (text or "").strip()
    if not body:
        raise ValueError("empty")
    fence = re.search(r"```(?:json)?\s*\n?(.*?)(?:```|$)", body, re.S)
    for part in (body, fence[1] if fence else ""):
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            continue
    body = fence[1] if fence and re.search(r"[{\[]", fence[1]) else body
    start = re.search(r"[{\[]", body)
    if not start:
        raise ValueError("no braces")
    return _Reader(body[start.start() :]).value()


def _finite(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


@F.arrow_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def lenient_json(text: pa.Array) -> pa.Array:
    """json: the value in a text as strict JSON, for from_json; or error: why there is none."""
    out = []
    for t in text.to_pylist():
        try:
            out.append({"json": _finite(read_lenient(t)), "error": None})
        except (ValueError, RecursionError) as e:
            out.append({"json": None, "error": str(e)[:200]})
    return pa.array(out, pa.struct([("json", pa.string()), ("error", pa.string())]))


def json_rows(json_text: Column, headers: list[str]) -> Column:
    """Rows (arrays of text in headers' order) of a strict JSON list of objects or one object: a header's own
    key, else the first key that contains it or that it contains; others are empty."""
    objects = F.from_json(F.when(json_text.startswith("["), json_text).otherwise(F.concat(F.lit("["), json_text, F.lit("]"))), "array<map<string,string>>")

    def cell(row: Column, header: str) -> Column:
        near = F.filter(F.map_keys(row), lambda k: (k != "") & (F.contains(k, F.lit(header)) | F.contains(F.lit(header), k)))
        return F.coalesce(F.try_element_at(row, F.lit(header)), F.try_element_at(row, F.get(near, F.lit(0))), F.lit(""))

    return F.transform(F.filter(objects, lambda r: r.isNotNull()), lambda row: F.array(*[cell(row, h) for h in headers]))


def shortened(c: Column, longest: int) -> Column:
    """A text's first characters, with its length behind them if it was cut."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("\n... (truncated, total "), F.length(c).cast("string"), F.lit(" chars)"))).otherwise(F.coalesce(c, F.lit("")))


def digit_runs(c: Column) -> Column:
    """All numbers of a text, without commas."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([-+]?\d[\d,]*(?:\.\d+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))


def smart_value(c: Column) -> Column:
    """struct(whole, real, text): what a template's cell should hold, exactly one of them set for a text
    that isn't empty."""
    bare = F.replace(F.trim(c), F.lit(","), F.lit(""))
    whole = F.when(bare.rlike(r"^[-+]?\d+$"), bare.try_cast("long"))
    real = F.when(whole.isNull() & bare.rlike(r"^[-+]?\d*\.\d+(?:[eE][-+]?\d+)?$"), bare.try_cast("double"))
    return F.struct(whole.alias("whole"), real.alias("real"), F.when(whole.isNull() & real.isNull(), c).alias("text"))
