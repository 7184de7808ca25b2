"""Counting repeated and copied events once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import epoch_ms

#: The columns that make two events the same, in the order they are hashed.
IDENTITY = ["source", "session_id", "ts", "repo_root", "provider", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd", "cost_mode"]


def _text(name: str, dtype: str) -> Column:
    if dtype.startswith("timestamp"):
        c = epoch_ms(F.col(name)).cast("string")
    elif dtype == "double":
        c = F.col(name).cast("decimal(38,12)").cast("string")
    else:
        c = F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """16 hex digits of the SHA-256 of an event's fields, joined by the unit separator; the one-hour split is left out."""
    types = dict(df.dtypes)
    parts = [_text(c, types[c]) for c in columns or IDENTITY if c in types]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 16)


def repeated_across_files(df: DataFrame, key: Column | None = None, file: str = "file", order: str = "event_index") -> DataFrame:
    """Each event as often as the file that has it most often; earlier files in order serve it.

    The n-th occurrence in a file is the same event as the n-th in any other.
    """
    hashed = df.withColumn("_hash", content_hash(df) if key is None else key)
    nth = hashed.withColumn("_nth", F.row_number().over(Window.partitionBy(file, "_hash").orderBy(order)))
    first = nth.withColumn("_first", F.row_number().over(Window.partitionBy("_hash", "_nth").orderBy(file)))
    return first.where("_first = 1").drop("_hash", "_nth", "_first")


def copied_sessions(df: DataFrame, order: str = "event_index") -> DataFrame:
    """Events once across sessions of a source: the same time, model and usage under compatible ids is a copy.

    Events with message or request ids are matched by both. The n-th event without ids takes the
    n-th identity of its time and usage, so it is never counted beside an event that has ids, and
    each session keeps as many as it has. The session that started first keeps the event.
    """
    usage = ["source", "ts", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
    start = F.min("ts").over(Window.partitionBy("source", "session_id"))
    rows = df.withColumn("_start", start).withColumn("_ids", F.when(F.col("message_id").isNotNull() | F.col("request_id").isNotNull(), F.concat_ws("\x1f", F.coalesce("message_id", F.lit("")), F.coalesce("request_id", F.lit("")))))
    rows = rows.withColumn("_k", F.coalesce(F.col("model"), F.lit("\x00")))
    group = [c for c in usage if c != "model"] + ["_k"]
    # identities in one order for all sessions of a group: those with ids first, then numbers
    with_ids = rows.withColumn("_slot", F.when(F.col("_ids").isNotNull(), F.dense_rank().over(Window.partitionBy(*group).orderBy(F.col("_ids").asc_nulls_last()))))
    spare = F.row_number().over(Window.partitionBy(*group, "session_id", F.col("_ids").isNull()).orderBy(order))
    slotted = with_ids.withColumn("_slot", F.coalesce("_slot", spare))
    once = F.row_number().over(Window.partitionBy(*group, "_slot").orderBy("_start", "session_id", F.col("_ids").isNull(), order))
    return slotted.withColumn("_once", once).where("_once = 1").drop("_start", "_ids", "_k", "_slot", "_once")


def tool_calls(df: DataFrame, order: str = "event_index") -> DataFrame:
    """The first call of each id in a source, with the status of the first copy that knows it; calls without an id stay."""
    whole = Window.partitionBy("source", "call_id").orderBy("ts", order)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.first(F.when(F.col("status") != "unknown", F.col("status")), ignorenulls=True).over(every)
    named = df.where("call_id is not null").withColumns({"_n": F.row_number().over(whole), "_status": known})
    named = named.where("_n = 1").withColumn("status", F.coalesce("_status", "status")).drop("_n", "_status")
    return named.unionByName(df.where("call_id is null"))


def request_key() -> Column:
    return F.to_json(F.struct("message_id", "request_id"))
