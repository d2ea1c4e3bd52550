"""Values of cells as Column expressions: cleaning, null tests, numbers, percents, dates, units.

All are built-in expressions, so they stay in generated code. Full-width forms of ASCII are
mapped by translate(); nfkc() is the exact form, a pandas UDF, for text with other compatibility
characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fuseline.functions.registry import DEFAULT, PUNCTUATION, Registry

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　\xa0"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
#: Fixed: Chinese numerals and the units that end a section.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL, LARGE = {"十": 10, "百": 100, "千": 1000}, {"万": 10_000, "亿": 100_000_000}


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility composition, exactly."""
    return c.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


#: Fixed: white space at the ends of a value.
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
assert sorted(re.findall(_SPACE.replace(r"\x{", "\\u").replace("}", ""), "".join(map(chr, range(0x3001))))) == sorted(_BLANK)


def is_ascii(c: Column) -> Column:
    """Whether a text holds printable ASCII alone: most values do, and need few of the steps below."""
    return c.rlike(r"\A[ -~]*\z")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once for each row, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def clean(c: Column) -> Column:
    """A cell's text; "" for null, blank and the words nan, none and nat."""
    word = lambda x: F.when(F.lower(x).isin("nan", "none", "nat"), "").otherwise(x)
    bare = lambda x: is_ascii(x) & ~x.startswith(" ") & ~x.endswith(" ")
    return let(F.coalesce(c.cast("string"), F.lit("")), lambda x: F.when(bare(x), word(x)).otherwise(let(trimmed(x), word)))


def plain(c: Column) -> Column:
    """clean() with full-width characters as ASCII and runs of white space as one space."""
    return plain_text(clean(c))


def plain_text(text: Column) -> Column:
    """plain() of a text that is clean() already."""
    full = lambda x: trimmed(F.regexp_replace(F.translate(x, _WIDE + "。", _PLAIN + "."), f"{_SPACE}+", " "))
    return let(text, lambda x: F.when(is_ascii(x) & ~x.contains("  "), x).otherwise(full(x)))


_LEFT_OUT = r"\([^)]*\)|" + PUNCTUATION.replace("[\\s", "[" + _SPACE[1:-1])


def name_key(c: Column) -> Column:
    """fuseline.functions.registry.name_key for text without other compatibility characters."""
    full = lambda x: F.regexp_replace(F.lower(trimmed(F.translate(x, _WIDE, _PLAIN))), _LEFT_OUT, "")
    return let(F.coalesce(c.cast("string"), F.lit("")), lambda x: F.when(x.rlike(r"\A[A-Za-z0-9#$%&+*=@]*\z"), F.lower(x)).otherwise(full(x)))


#: A minus before a value's number, and the point of its only number.
_MINUS, _POINT = r"\A-(?=[$¥￥€£ ]?\d)", r"\A([^\d.]*\d[\d,]*)\.(\d+[^\d.]*)\z"


def value_key(c: Column, key: Column) -> Column:
    """name_key() of a value, given as key, but where the value is one number, with or without a unit, its sign and
    point stay: -1.25, 1.25 and 12.5 are different values, while headers and names are compared without punctuation."""
    wide = F.translate(c, _WIDE, _PLAIN)
    marked = F.regexp_replace(F.regexp_replace(wide, _MINUS, "−"), _POINT, "$1∙$2")
    # a plain number is its own key; values without either mark have the given one
    own = F.when(c.contains(".") | c.startswith("-") | ~is_ascii(c), F.translate(name_key(marked), "−∙", "-."))
    return F.when(c.rlike(r"\A-?\d+(?:\.\d+)?\z"), c).otherwise(F.coalesce(own, key))


def is_missing(c: Column, registry: Registry = DEFAULT) -> Column:
    return is_null_text(plain(c), registry)


def is_null_text(text: Column, registry: Registry = DEFAULT) -> Column:
    """is_missing() of a plain() text. Letters and digits alone, longer than any null token, are none."""
    tokens = sorted(registry.null_keys())
    longer = lambda x: x.rlike(rf"\A[A-Za-z0-9]{{{max(map(len, tokens)) + 1},}}\z")
    return let(text, lambda x: ~longer(x) & name_key(x).isin(*tokens))


def chinese_number(c: Column) -> Column:
    """The value of the Chinese numerals in a text, null if there are none."""
    known = {**{k: (0, v) for k, v in DIGITS.items()}, **{k: (1, v) for k, v in SMALL.items()}, **{k: (2, v) for k, v in LARGE.items()}}
    chars = F.filter(F.split(c, ""), lambda x: x.isin(*known))
    kind = F.create_map(*[x for k, (i, _) in known.items() for x in (F.lit(k), F.lit(i))])
    worth = F.create_map(*[x for k, (_, v) in known.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("digit"))

    def step(s: Column, x: Column) -> Column:
        k, v, one = kind[x], worth[x], F.lit(1).cast("long")
        zero = F.lit(0).cast("long")
        or_one = lambda n: F.when(n == 0, one).otherwise(n)
        return (
            F.when(k == 0, F.struct(s["total"].alias("total"), s["section"].alias("section"), v.alias("digit")))
            .when(k == 1, F.struct(s["total"].alias("total"), (s["section"] + or_one(s["digit"]) * v).alias("section"), zero.alias("digit")))
            .otherwise(F.struct((s["total"] + or_one(s["section"] + s["digit"]) * v).alias("total"), zero.alias("section"), zero.alias("digit")))
        )

    return F.when(c.rlike(f"[{''.join(known)}]"), F.aggregate(chars, state, step, lambda s: s["total"] + s["section"] + s["digit"]))


def multiplier(text: Column) -> Column:
    return F.when(text.contains("万亿"), 1e12).when(text.contains("亿"), 1e8).when(text.contains("万"), 1e4).otherwise(1.0)


def number(c: Column) -> Column:
    """The first number in a text times the unit 万, 亿 or 万亿 anywhere in it (double)."""
    return text_number(plain(c))


def text_number(text: Column) -> Column:
    value = lambda x: F.replace(F.regexp_extract(x, f"({NUMBER})", 1), F.lit(","), F.lit("")).try_cast("double")
    return let(text, lambda x: F.coalesce(F.round(value(x) * multiplier(x), 8), chinese_number(x) * multiplier(x)))


def percent(c: Column) -> Column:
    """number() as a fraction where the text has % or 百分."""
    return text_percent(plain(c))


def text_percent(text: Column) -> Column:
    return let(text, lambda x: F.round(text_number(x) / F.when(x.contains("%") | x.contains("百分"), 100).otherwise(1), 8))


def date(c: Column) -> Column:
    """yyyy-MM-dd of a text that starts with a date; parts that can't be are left off, so that a
    month or a year alone gives its first day. Null if there is none."""
    return text_date(plain(c))


def text_date(text: Column) -> Column:
    def loose(t: Column) -> Column:
        """Dates of any form: year|month|day, parts that aren't there left empty; a text without a year stays."""
        t = F.regexp_replace(t, "-+", "-")
        return let(F.regexp_replace(t, r"(?s)^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?|(\d{2}))?.*$", "$1|$2$4|$3"), best)

    def best(p: Column) -> Column:
        day = lambda x: F.replace(x, F.lit("|"), F.lit("-")).try_cast("date")
        year = F.substring_index(p, "|", 1)
        found = F.coalesce(day(p), day(F.substring_index(p, "|", 2)), F.when(year != "0000", day(year)))
        return F.when(p.contains("|"), found.cast("string"))

    def read(t: Column) -> Column:
        whole = F.when(t.rlike(r"\A(?!0000)\d{4}(?:-\d{1,2}){0,2}\z"), t.try_cast("date").cast("string"))
        return F.coalesce(whole, loose(t))

    return let(F.btrim(F.translate(text, "年月/.日", "----"), F.lit("- ")), read)


def unit(c: Column, registry: Registry = DEFAULT) -> Column:
    """The longest known unit in a text, else letters or % behind a number, else ""."""
    return text_unit(plain(c), registry)


def text_unit(text: Column, registry: Registry) -> Column:
    units = sorted(registry.units, key=len, reverse=True)
    first = lambda x, us: F.coalesce(*[F.when(x.contains(u), F.lit(u)) for u in us], F.regexp_extract(x, NUMBER + r"\s*([A-Za-z%]+)", 1))
    return let(text, lambda x: F.when(is_ascii(x), first(x, [u for u in units if u.isascii()])).otherwise(first(x, units)))


def rendered(value: Column) -> Column:
    """A double as text without exponent: whole numbers without a point."""
    whole = value == F.floor(value)
    exact = F.regexp_replace(value.cast("decimal(30,8)").cast("string"), r"\.?0+$", "")
    small = whole & (F.abs(value) < 1e15)
    return F.when(small, value.cast("long").cast("string")).when(whole, value.cast("decimal(30,0)").cast("string")).otherwise(exact)


def typed(c: Column, kind: str, registry: Registry = DEFAULT) -> Column:
    """struct(original, standard_value, num, field_type, unit, status) of a value of this type;
    status is null, ok or type_error."""
    return typed_text(plain(c), clean(c), is_missing(c, registry), kind, registry)


def typed_text(text: Column, original: Column, null: Column, kind: str, registry: Registry = DEFAULT) -> Column:
    """typed() from plain(), clean() and is_missing() of a value, so that a plan that has them as
    columns computes them once."""
    num = text_percent(text) if kind == "percent" else text_number(text) if kind in ("number", "currency") else F.lit(None).cast("double")
    value = rendered(num) if kind in ("number", "currency", "percent") else text_date(text) if kind == "date" else text
    own = text_unit(text, registry)
    found = F.lit("") if kind == "date" else F.when(text.contains("%"), "%").otherwise(own) if kind == "percent" else own
    return F.struct(
        original.alias("original"),
        F.when(null, "").otherwise(F.coalesce(value, text)).alias("standard_value"),
        F.when(~null, num).alias("num"),
        F.lit(kind).alias("field_type"),
        F.when(null, "").otherwise(found).alias("unit"),
        F.when(null, "null").when(value.isNull(), "type_error").otherwise("ok").alias("status"),
    )
