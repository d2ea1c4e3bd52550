"""Sources by specification, read one by one without letting a bad one stop the others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.sources import database, readers

TABULAR = {".csv": readers.read_csv, ".json": readers.read_json}


@dataclass(frozen=True)
class Source:
    """kind: file, http or sqlite; path: file or folder, or the URL; query for sqlite."""

    kind: str
    path: str
    query: str = ""
    priority: int = 0
    options: dict[str, str] = field(default_factory=dict)


def load(spark: SparkSession, source: Source) -> DataFrame:
    """A source's rows: tables as they are, office files and Markdown tables as cells, text as blocks."""
    if source.kind == "sqlite":
        database.register(spark)
        return spark.read.format("sqlite_query").options(path=source.path, query=source.query, **source.options).load()
    if source.kind == "http":
        database.register(spark)
        return spark.read.format("http_get").options(urls=source.path, **source.options).load()
    if source.kind != "file":
        raise ValueError(f"unknown kind of source: {source.kind}")
    ending = source.path[source.path.rfind(".") :].lower()
    if ending in TABULAR:
        return TABULAR[ending](spark, source.path)
    if ending in (".xlsx", ".docx"):
        return readers.office_cells(spark, source.path)
    if ending in (".md", ".txt"):
        return readers.read_blocks(spark, source.path)
    if ending == ".parquet":
        return spark.read.parquet(source.path)
    raise ValueError(f"unknown ending: {ending}")


def load_all(spark: SparkSession, sources: list[Source]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(rows by path, errors by path)."""
    good, bad = {}, {}
    for s in sources:
        try:
            good[s.path] = load(spark, s)
        except (ValueError, OSError, PySparkException) as e:
            bad[s.path] = str(e).splitlines()[0]
    return good, bad


def preview(spark: SparkSession, sources: list[Source], rows: int = 20, width: int = 1200) -> DataFrame:
    """path, status, columns and a JSON sample of the first rows of each source."""
    good, bad = load_all(spark, sources)
    out = [(p, "error", [], m) for p, m in bad.items()]
    for p, df in good.items():
        cut = df.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns])
        out.append((p, "ok", df.columns, "\n".join(cut.limit(rows).toJSON().collect())))
    return spark.createDataFrame(out, "path string, status string, columns array<string>, sample string")
