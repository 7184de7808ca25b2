"""Incremental ingest: file streams of log lines into usage, with watermarks for late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmeter.operators.dedupe import content_hash
from quillmeter.sources.sinks import upsert_ledger


def usage_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Normalized rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows counted once by content within the watermark, which bounds the state; event_time is ts with a zone."""
    timed = stream.withColumn("event_time", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    hashed = timed.withColumn("content_hash", content_hash(stream))
    return hashed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["content_hash"])


def hourly(stream: DataFrame) -> DataFrame:
    """Tokens by source and hour; a window closes once the watermark has passed it."""
    return stream.groupBy(F.window("event_time", "1 hour").alias("w"), "source").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "source", "total_tokens", "events")


def active_sessions(stream: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Session windows of five minutes without events."""
    return stream.groupBy("source", "session_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("events"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))


def to_ledger(stream: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Each batch adds its rows to the ledger; a row replaces the one stored for its place in its file.

    So a file whose rows come in several batches keeps them all, and a replayed batch changes nothing.
    """
    return stream.writeStream.foreachBatch(lambda rows, _: upsert_ledger(rows, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
