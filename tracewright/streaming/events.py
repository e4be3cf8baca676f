"""Event counts over time, as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Events by tumbling window and type."""
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def stream_counts(spark: SparkSession, path: str, pattern: str = "events*.parquet", minutes: int = 60, late: str = "1 hour", name: str = "event_counts") -> DataFrame:
    """All that is at ``path`` now, through a stream with a watermark into a table in memory."""
    schema = spark.read.parquet(f"{path}/{pattern.replace('*', '')}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    query = counts(stream.withWatermark("ts", late), minutes).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")
