"""Quality counters of a stream of events, and a streaming import into the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fuseline.operators.store import import_batch


def event_counters(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, missing and negative values by window and type; works on batches and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count_if(F.col("value") < 0).alias("n_negative"), F.round(F.sum("value"), 4).alias("sum_value")
    )
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "n_missing", "n_negative", "sum_value")


def import_stream(docs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Imports each micro-batch under its number, so a repeated batch overwrites itself."""
    return docs.writeStream.foreachBatch(lambda df, n: import_batch(df, root, f"s{n:08d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
