"""Streams of events: session windows, tumbling counts with late data, latest state of each key.

The same functions take batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.keyed import KeyedTable


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which needs times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events less than a gap apart."""
    w = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return w.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows; what comes later than `late` is not counted by a stream."""
    w = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def upsert_into(stream: DataFrame, table: KeyedTable, order: str, checkpoint: str, **trigger):
    """Keeps the latest row of each key in a table: a micro-batch rewrites the partitions of its keys and no others.

    Batches are numbered, so one that runs again changes nothing.  Returns the running query (default: all there is).
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, [order], number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
