"""Row filters of a requirement: soft ones are ignored where they would leave nothing.

A soft filter needs to know whether any row matches. That one bit comes from an aggregation that
short-circuits to a count per partition; the rows are read once more, not collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import trimmed
from fuseline.operators.mapping import match_headers


@dataclass(frozen=True)
class Requirement:
    """What is asked for: a range of dates (soft), values by column (hard), entities (soft), a
    number of rows, and the order they come in (None: as in the source)."""

    dates: tuple[str, str] | None = None
    filters: dict[str, Sequence[str]] = field(default_factory=dict)
    entities: Sequence[str] = ()
    top_n: int | None = None
    sort_by: str | None = None
    descending: bool = True


def soft(df: DataFrame, condition: Column) -> DataFrame:
    """df where condition holds, or all of df if it holds nowhere."""
    hit = F.coalesce(condition, F.lit(False))
    some = df.agg(F.max(hit).alias("_some"))
    return df.join(F.broadcast(some), F.lit(True)).filter(hit | ~F.coalesce(F.col("_some"), F.lit(False))).drop("_some")


def cell_date(c: Column) -> Column:
    """The timestamp of a text that is a date, or in which there is one."""
    text = F.regexp_replace(trimmed(c), r"\.0$", "")
    part = lambda k: F.regexp_extract(c, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", k)
    inside = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    whole = F.regexp_replace(F.regexp_replace(text, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"), r"^(\d{4}-\d{1,2}-\d{1,2}) (\d{2}:\d{2}:\d{2})(\.\d+)?$", "$1 $2$3")
    return F.when(text.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}( \d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?)?$"), whole.try_cast("timestamp")).otherwise(inside.try_cast("timestamp"))


def in_dates(c: Column, start: str, end: str) -> Column:
    """Whether the date is from start to end; end is its first instant."""
    at = cell_date(c)
    return F.coalesce((at >= F.lit(start).try_cast("timestamp")) & (at <= F.lit(end).try_cast("timestamp")), F.lit(False))


def filter_text(c: Column) -> Column:
    """A text as filters compare it; ".0" goes wherever it stands."""
    text = F.regexp_replace(F.translate(F.lower(trimmed(c)), "/年月日号", "---"), r"\.0", "")
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "--", "-"))


def value_match(c: Column, wanted: str) -> Column:
    """Equal, or one within the other, as filters compare them."""
    cell, want = filter_text(c), filter_text(F.lit(wanted))
    return (c != "") & F.lit(wanted != "") & (cell.contains(want) | F.contains(want, cell))


def entity_match(c: Column, entities: Sequence[str]) -> Column:
    """Whether the cell contains an entity or is within one, as an empty cell is."""
    out = F.lit(False)
    for e in entities:
        out |= F.contains(trimmed(c), F.lit(e)) | F.contains(F.lit(e), trimmed(c))
    return out


def same_date(a: Column, b: Column) -> Column:
    plain = lambda c: F.translate(F.regexp_replace(trimmed(c), r"\.0$", ""), "/.", "--")
    return (a != "") & (b != "") & (plain(a) == plain(b))


def apply_table_spec(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """df where the columns that match the spec's keys hold their values, contain them, lie within them or are
    the same date; a key that would leave nothing, or that no column matches, is passed over."""
    for key, value in spec.items():
        if pairs := match_headers([key], df.columns):
            cell = trimmed(F.coalesce(F.col(f"`{pairs[0][1]}`").cast("string"), F.lit("")))
            want = F.lit(value)
            df = soft(df, cell.contains(want) | F.contains(want, cell) | same_date(cell, want))
    return df


def apply_requirement(df: DataFrame, need: Requirement, date_column: str | None = None, entity_column: str | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """df after the date range, the values, the entities and the number of rows, in this order.
    order: the source's order, needed for a number of rows."""
    if need.dates and date_column:
        df = soft(df, in_dates(F.col(date_column), *need.dates))
    for column, values in need.filters.items():
        if values and column in df.columns:
            hit = F.lit(False)
            for v in values:
                hit |= value_match(F.col(column).cast("string"), v)
            df = df.filter(hit)
    if need.entities and entity_column:
        df = soft(df, entity_match(F.col(entity_column), need.entities))
    if need.top_n:
        by = [F.desc(need.sort_by) if need.descending else F.asc(need.sort_by), *order] if need.sort_by else list(order)
        df = df.orderBy(*by).limit(need.top_n)
    return df


def between_and_in(df: DataFrame, dates: dict[str, tuple[str, str]] | None = None, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """df where dates lie between two days, both included, and columns have one of some values."""
    for column, (start, end) in (dates or {}).items():
        df = df.filter(F.to_date(cell_date(F.col(column).cast("string"))).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for column, allowed in (values or {}).items():
        df = df.filter(F.col(column).cast("string").isin(*allowed))
    return df
