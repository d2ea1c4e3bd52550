"""Narrative text: blocks, sentences, relevance, sessions of blocks about one entity, summaries,
topics and placeholder replacement."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuseline.functions.values import clean, plain, trimmed

SENTENCE_END = r"(?<=[。！？.!?])\s*"


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, block_index, content, heading_level: paragraphs between blank lines, or, where
    there is only one, lines. A leading run of # makes a heading."""
    body = F.coalesce(F.col(text), F.lit(""))
    full = lambda parts: F.filter(F.transform(parts, trimmed), lambda x: x != "")
    paragraphs, lines = full(F.split(body, r"\n\s*\n", -1)), full(F.split(body, "\n", -1))
    chosen = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(lines)
    out = docs.select("doc_id", F.posexplode(chosen).alias("block_index", "content"))
    return out.withColumn("heading_level", F.length(F.regexp_extract("content", r"^(#{1,6}) ", 1)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(plain(c), SENTENCE_END), lambda x: x != "")


def summarize(docs: DataFrame, text: str = "text", least: int = 12, points: int = 8, lead: int = 3) -> DataFrame:
    """doc_id, key_points and summary: the first points sentences of at least so many characters, and the
    first lead of them in at most 800 characters, as a summary is meant to be."""
    found = F.slice(F.filter(sentences(F.col(text)), lambda x: F.length(x) >= least), 1, points)
    return docs.select("doc_id", found.alias("key_points")).withColumn("summary", F.substring(F.concat_ws(" ", F.slice("key_points", 1, lead)), 1, 800))


def relevant(content: Column, words: Sequence[str], least: int = 18) -> Column:
    """Long enough, with a number, and with one of the words."""
    hit = F.lit(False)
    for w in words:
        hit |= F.lower(content).contains(w.lower())
    return (F.length(content) >= least) & content.rlike(r"\d") & hit


def top_segments(segments: DataFrame, score: Column, k: int) -> DataFrame:
    """Each document's k segments of the highest score, the earlier of equal ones. Spark keeps each
    task's k best of a document before the shuffle, so no document's blocks are gathered."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "block_index"))
    best = segments.withColumn("score", score).withColumn("place", place - 1).filter(F.col("place") < k)
    return best.select("doc_id", "place", "block_index", "content", "score")


#: A block that stands alone: a list item, or one with a number, a date or a label.
ALONE = r"^\s*(?:\d+[.)、]|[一二三四五六七八九十]+、|[-*•])\s+|\d|[^：:\s]{1,16}[：:][^：:]{1,32}"


def continuations(segments: DataFrame, entity: Column, longest: int = 180) -> DataFrame:
    """doc_id, group_no, first_block, n_blocks and content: short blocks without an entity, a number or a
    label go on the block before them."""
    doc = Window.partitionBy("doc_id").orderBy("block_index")
    start = (F.coalesce(entity, F.lit("")) != "") | F.col("content").rlike(ALONE) | (F.length("content") > longest) | (F.row_number().over(doc) == 1)
    rows = segments.withColumn("_start", start.cast("int"))
    rows = rows.withColumn("group_no", F.sum("_start").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("block_index", "content")))
    out = rows.groupBy("doc_id", "group_no").agg(F.min("block_index").alias("first_block"), F.count("*").alias("n_blocks"), parts.alias("parts"))
    return out.select("doc_id", "group_no", "first_block", "n_blocks", F.concat_ws("\n", "parts.content").alias("content"))


def entity_blocks(segments: DataFrame, entity: Column, longest: int = 1400) -> DataFrame:
    """doc_id, group_no, first_block, n_blocks, n_chars: neighbouring blocks of a document about one
    entity. A new group starts at a heading, a list item, where the entity changes (a block without
    one goes on) or where the characters since the document's start pass a multiple of longest."""
    doc = Window.partitionBy("doc_id").orderBy("block_index")
    known = F.last(F.when(entity != "", entity), ignorenulls=True)
    rows = segments.withColumn("_e", known.over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(F.length("content")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", F.floor(F.coalesce(size, F.lit(0)) / longest))
    item = F.col("content").rlike(r"^(?:[-*•]|\d+[.)、]) ?")
    change = ~F.col("_e").eqNullSafe(F.lag("_e").over(doc)) | (F.col("_part") != F.lag("_part").over(doc))
    start = F.lag("block_index").over(doc).isNull() | (F.col("heading_level") > 0) | item | change
    rows = rows.withColumn("group_no", F.sum(start.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "group_no").agg(F.min("block_index").alias("first_block"), F.count("*").alias("n_blocks"), F.sum(F.length("content")).alias("n_chars"))


def tokens(c: Column) -> Column:
    """The different words of a text: runs of Latin letters and digits, and up to four ideographs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(plain(c)), F.lit("([a-z0-9]+|[一-龥]{1,4})"), 1))


def relevance(c: Column, wanted: str) -> Column:
    """How many words of wanted a text has."""
    return F.size(F.array_intersect(tokens(c), tokens(F.lit(wanted))))


def stem(c: Column) -> Column:
    """A path's file name without its ending."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def topic_text(c: Column) -> Column:
    """A name without digits, blanks and dashes, for loose comparison."""
    return F.regexp_replace(F.lower(c), r"(?U)[\d_\- ]+", "")


def topic_tokens(c: Column) -> Column:
    """The different topic words of a text: runs of 2 to 12 letters, digits and ideographs, not all digits."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([一-龥A-Za-z0-9]{2,12})"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~x.rlike("^[0-9]+$")), F.lower))


def topic_overlap(c: Column, wanted: Column) -> Column:
    """The topic words that two texts share, in the first one's order."""
    return F.array_intersect(topic_tokens(c), topic_tokens(wanted))


def find(docs: DataFrame, query: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """doc_id, block_index and content of the blocks that contain query; of the first ones if a limit is given."""
    hits = blocks(docs, text).filter(F.col("content").contains(query)).select("doc_id", "block_index", "content")
    return hits if limit is None else hits.orderBy("doc_id", "block_index").limit(limit)


def titles(docs: DataFrame, name: Column, text: str = "text") -> DataFrame:
    """doc_id and title: the first line of 2 to 80 characters that starts one of the first six blocks, else the
    file's name without its ending."""
    first = F.when(F.col("block_index") < 6, F.get(F.split("content", "\n"), F.lit(0)))
    line = F.when(F.length(trimmed(first)).between(2, 80), trimmed(first))
    found = blocks(docs, text).withColumn("line", line).filter("line is not null").groupBy("doc_id").agg(F.min_by("line", "block_index").alias("line"))
    return docs.select("doc_id", stem(name).alias("name")).join(found, "doc_id", "left").select("doc_id", F.coalesce("line", "name").alias("title"))


def topics(docs: DataFrame, name: Column, text: str = "text") -> DataFrame:
    """doc_id, title, topic and topic_tokens: the topic is the title if it has 2 to 80 characters, else the file's name, else the
    first line of one of the first four blocks of which that holds, and without any the file's name again; its
    tokens are the different runs of 2 to 20 Latin letters and of 2 to 16 ideographs, in small letters and sorted."""
    fits = lambda c: F.when(F.length(clean(c)).between(2, 80), clean(c))
    line = fits(F.when(F.col("block_index") < 4, F.get(F.split("content", "\n"), F.lit(0))))
    lines = blocks(docs, text).withColumn("line", line).filter("line IS NOT NULL").groupBy("doc_id").agg(F.min_by("line", "block_index").alias("line"))
    named = docs.select("doc_id", stem(name).alias("name")).join(titles(docs, name, text), "doc_id").join(lines, "doc_id", "left")
    out = named.select("doc_id", "title", F.coalesce(fits(F.col("title")), fits(F.col("name")), "line", "name").alias("topic"))
    runs = F.regexp_extract_all("topic", F.lit("([A-Za-z]{2,20}|[\u4e00-\u9fa5]{2,16})"), 1)
    return out.withColumn("topic_tokens", F.array_sort(F.array_distinct(F.transform(runs, F.lower))))


def replace_placeholders(c: Column, values: dict[str, str]) -> Column:
    """{{x}}, {x}, 【x】 and ${x} replaced by values[x], of marks at one place the longest. A text is gone through once: marks
    within a value that was put in stay as they are, and so do those of unknown names."""
    if not values:
        return c
    marks = {m: v for name, v in values.items() for m in (f"{{{{{name}}}}}", f"${{{name}}}", f"{{{name}}}", f"【{name}】")}
    quoted = "|".join(re.sub(r"([\\\[\](){}.*+?^$|#&~-])", r"\\\1", m) for m in sorted(marks, key=lambda m: (-len(m), m)))
    known = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    # each piece between marks with the mark behind it
    pieces = F.arrays_zip(F.split(c, quoted, -1).alias("text"), F.regexp_extract_all(c, F.lit(f"({quoted})"), 1).alias("mark"))
    whole = F.concat_ws("", F.transform(pieces, lambda p: F.concat(p["text"], F.coalesce(F.try_element_at(known, p["mark"]), F.lit("")))))
    return F.when(c.isNotNull(), whole)


def narrative_profile(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_chars and whether the document is narrative: more blocks than lines of tables."""
    b = blocks(docs)
    table = F.col("content").rlike(r"\|.*\|")
    out = b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("content")).alias("n_chars"), F.count_if(table).alias("n_table_blocks"))
    return out.withColumn("narrative", F.col("n_blocks") > 2 * F.col("n_table_blocks"))


def labelled_values(docs: DataFrame, labels: Sequence[str], text: str = "text") -> DataFrame:
    """doc_id, label and value of "label: value" lines."""
    out = F.array(*[F.struct(F.lit(w).alias("label"), F.regexp_extract(F.coalesce(F.col(text), F.lit("")), rf"(?im)^\s*{re.escape(w)}\s*[:=：]\s*(.+?)\s*$", 1).alias("value")) for w in labels])
    return docs.select("doc_id", F.inline(out)).filter(clean(F.col("value")) != "")
