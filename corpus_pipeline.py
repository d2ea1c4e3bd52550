"""From documents to packed training sequences, in five stages of fuseline.llm.

Each stage takes what its predecessor kept. A document leaves if the quality classifier rejects
it, if line dedup removes all its words, or if a more senior near copy stays; mixing repeats or leaves
out documents to meet the sources' targets; packing gives the pieces and their sequences.

All stages take nulls in any column, empty and very long texts, rows that share a doc_id or repeat, empty tables
and columns of any name, and pass other columns on; each says what it makes of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import WORD, stored
from fuseline.llm.line_dedup import deduplicated
from fuseline.llm.mixing import mix
from fuseline.llm.packing import pack_documents
from fuseline.llm.quality_classifier import THRESHOLD, learn, score_documents
from fuseline.llm.shingle_join import drop_copies
from fuseline.llm.tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that score below the threshold. A null text scores as an empty one does; rows are
    scored each."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.filter(F.col("score") >= THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the later copies of repeated runs of lines, and less documents of which no words
    are left. n_chars, where docs has it, is the new length. Null and empty texts, from which nothing goes, and
    rows without doc_id stay as they are; rows that repeat doc_id and text are treated alike."""
    left = deduplicated(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def shingle_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id (of several with that id, of the least
    hash of its text), once. Rows without doc_id or words stay."""
    return drop_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as the mix takes it. A null text has size 0; a null source is a source, and the last."""
    return mix(docs, with_docs=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs with their sequences. A null text is one piece, the end id."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("shingle_join", shingle_join),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer, boosted or linear models; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
