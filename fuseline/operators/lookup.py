"""A task's requirement text where nobody gave one: the file of a known name that lies nearest to the task's own files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuseline.functions.values import trimmed


# Fixed: names of a requirement's file, the first ones first.
NAMES = ("用户要求.txt", "requirement.txt", "需求.txt", "说明.txt", "README.txt")


def parent(path: Column) -> Column:
    """A path's folder; "" for a name alone, "/" for what lies at the top."""
    folder = F.regexp_replace(path, "/+[^/]*/*$", "")
    return F.when(~F.contains(path, F.lit("/")), "").when((folder == "") & path.startswith("/"), "/").otherwise(folder)


def requirements_beside(paths: DataFrame, files: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """task, path and text of the requirement of each task of paths (task, place, path) that has one among files (path, text).

    Folders are searched in the order of place, a file's own folder before the one above it, and in a folder the names in
    their order; a blank text is none. Tasks and files meet by an equi-join on folders, and of a task's finds the first is kept by
    partial sums before the shuffle, so a folder that very many tasks share is no group."""
    up = F.array(F.struct(F.lit(0).alias("level"), parent(F.col("path")).alias("folder")), F.struct(F.lit(1).alias("level"), parent(parent(F.col("path"))).alias("folder")))
    searched = paths.filter("path IS NOT NULL").select("task", "place", F.inline(up)).groupBy("task", "folder").agg(F.min(F.struct("place", "level")).alias("at"))
    rank = F.array_position(F.array(*map(F.lit, names)), F.regexp_extract("path", "([^/]*)$", 1))
    found = files.select(parent(F.col("path")).alias("folder"), rank.alias("name"), F.col("path").alias("file"), trimmed(F.col("text")).alias("found")).filter("name > 0 AND found <> ''")
    best = searched.join(found, "folder").groupBy("task").agg(F.min(F.struct("at", "name", "file")).alias("best"))
    return best.select("task", F.col("best.file").alias("file")).join(found.select("file", "found"), "file").select("task", F.col("file").alias("path"), F.col("found").alias("text"))
