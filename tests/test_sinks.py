"""The workbook sink: what is written is what is read, once, also when tasks fail."""

from __future__ import annotations

import io
import os

import pytest
from pyspark.sql import functions as F

from fuseline.sources import sinks
from fuseline.sources.readers import sheet_rows


def test_a_workbook_of_odd_values():
    rows = [(1, "a<b>&\"c\"", None, 2.5, True), (-3, " two\nlines\x01 ", "", float("nan"), False), (1 << 60, "é🙂中", "x", 1e300, None)]
    out = io.BytesIO()
    assert sinks.write_workbook(out, ["n", "t&t", "e", "f", "b"], iter(rows)) == 3
    name, got = next(sheet_rows(out.getvalue()))
    assert name == "Sheet1" and got[0] == ["n", "t&t", "e", "f", "b"]
    assert got[1][:2] == ["1", 'a<b>&"c"'] and got[2][0] == "-3" and got[3][0] == str(1 << 60) and got[3][1] == "é🙂中"
    with pytest.raises(ValueError, match="32767"):
        sinks.write_workbook(io.BytesIO(), ["x"], iter([("y" * 40_000,)]))


def cells(spark, path):
    return sorted((r["cells"][0], r["cells"][1]) for r in sinks.read_workbooks(spark, path).filter("row_no > 0").collect())


def test_sink(spark, tmp_path):
    sinks.register(spark)
    path = str(tmp_path / "books")
    df = spark.range(1000).select("id", F.concat(F.lit("row "), "id").alias("name")).repartition(5)
    df.write.format("xlsx").mode("append").option("max_rows", 150).save(path)
    want = sorted((str(i), f"row {i}") for i in range(1000))
    assert cells(spark, path) == want
    sizes = sinks.read_workbooks(spark, path).groupBy("file").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) == 151
    df.limit(7).write.format("xlsx").mode("append").save(path)
    assert len(cells(spark, path)) == 1007
    df.write.format("xlsx").mode("overwrite").save(path)
    assert cells(spark, path) == want and not [f for f in os.listdir(path) if f.startswith("_")]
    df.filter("false").write.format("xlsx").mode("overwrite").save(path)
    assert [f for f in os.listdir(path) if f.endswith(".xlsx")] == []
    with pytest.raises(Exception, match="max_rows"):
        df.write.format("xlsx").mode("append").option("max_rows", 0).save(path)


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A task that fails after its rows are staged ends the job: what was there stays, nothing of the job does."""
    sinks.register(spark)
    path = str(tmp_path / "books")
    good = spark.range(10).select("id", F.lit("x").alias("name"))
    good.write.format("xlsx").mode("append").save(path)
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 99, F.repeat(F.lit("y"), 40_000)).otherwise("z").alias("name"))
    with pytest.raises(Exception, match="32767"):
        bad.write.format("xlsx").mode("overwrite").save(path)
    assert len(cells(spark, path)) == 10 and not [f for f in os.listdir(path) if f.startswith("_")]


def test_repeated_tasks_count_once(tmp_path):
    """Two attempts of a task stage their files; the one that the driver commits is all that is left."""
    writer = sinks.XlsxWriter({"path": str(tmp_path)}, ["a"], False)
    (tmp_path / writer.staging).mkdir()
    for name in ("part-0-first.xlsx", "part-0-second.xlsx"):
        with open(tmp_path / writer.staging / name, "wb") as f:
            sinks.write_workbook(f, ["a"], iter([(1,)]))
    writer.commit([sinks.Written(["part-0-second.xlsx"], 1), None])
    assert os.listdir(tmp_path) == ["part-0-second.xlsx"]
