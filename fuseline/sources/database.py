"""SQLite query results and HTTP responses as Spark data sources (spark.read.format(...))."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SqliteSource(DataSource):
    """Options: path, query and, to read in parallel, partition_column (an integer of the query's
    result) with lower, upper and partitions. Every column is text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_query"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [d[0] for d in db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").description]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema):
        return _SqliteReader(dict(self.options))


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if "partition_column" not in o:
            return [InputPartition(None)]
        low, high, n = int(o["lower"]), int(o["upper"]), int(o.get("partitions", 8))
        cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [InputPartition(p) for p in zip(cuts[:-1], cuts[1:], strict=True) if p[0] < p[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        where = "" if partition.value is None else f" WHERE {self.options['partition_column']} >= {partition.value[0]} AND {self.options['partition_column']} < {partition.value[1]}"
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT * FROM ({self.options['query']}){where}"):
                yield tuple(None if v is None else str(v) for v in row)


class HttpSource(DataSource):
    """One row (url, status, content_type, body) for each of the comma-separated urls; http and https only."""

    @classmethod
    def name(cls) -> str:
        return "http_get"

    def schema(self) -> str:
        return "url string, status int, content_type string, body string"

    def reader(self, schema):
        return _HttpReader(self.options["urls"].split(","), float(self.options.get("timeout", "30")))


class _HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.error
        import urllib.request

        url = partition.value
        if not url.startswith(("http://", "https://")):
            raise ValueError("only http and https URLs are read")
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as r:
                yield url, r.status, r.headers.get("Content-Type", ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            yield url, e.code, "", ""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(HttpSource)
