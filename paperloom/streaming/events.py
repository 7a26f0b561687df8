"""Structured Streaming forms: windowed counts with late data, id de-duplication, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import upsert


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each type in tumbling windows of event time; the same plan for a table and a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,6)")), 6).cast("double").alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def distinct_ids(stream: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Lays each micro-batch over the table; a repeated batch gives the same table."""

    def each(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch, key, order))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
