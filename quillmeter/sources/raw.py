"""Reading raw logs: lines with their places, JSON values, and the row normalizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import numbers, text

MOST_TOKENS = 10**12


def distinct_roots(paths: list[str]) -> list[str]:
    """Folders without those that are given twice or lie below another, so that no file is read twice."""
    plain = sorted({p.rstrip("/") or "/" for p in paths}, key=len)
    kept: list[str] = []
    for p in plain:
        if not any(p == k or p.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(p)
    return kept


def _roots(path: str | list[str]) -> str | list[str]:
    return path if isinstance(path, str) else distinct_roots(path)


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None, needles: list[str] | None = None) -> DataFrame:
    """(file, line, value, j): the lines of files below path, in their order, with their JSON value.

    Lines without any of `needles` are dropped before they are parsed; j is null for malformed
    lines. `line` grows within a file: the split's place first, then the row's place in it.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(_roots(path))
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    if needles:
        raw = raw.where(reduce(lambda a, b: a | b, [F.col("value").contains(n) for n in needles]))
    raw = raw.where(F.trim("value") != "")
    return raw.select("file", F.struct("_block", "_row").alias("line"), "value", F.try_parse_json("value").alias("j"))


def classified(spark: SparkSession, path: str | list[str], kinds: dict[str, list[str]], glob: str | None = None) -> DataFrame:
    """lines that hold a needle of any kind, read once, with a column a kind that says whether it holds one of that kind's."""
    found = lines(spark, path, glob, [n for needles in kinds.values() for n in needles])
    return found.withColumns({k: reduce(lambda a, b: a | b, [F.col("value").contains(n) for n in needles]) for k, needles in kinds.items()})


def documents(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """(file, j): whole JSON files."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(_roots(path))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("j"))


def items(df: DataFrame, path: str, name: str = "x") -> DataFrame:
    """A row for each element of the array at path, with its place as `line`."""
    return df.select("*", F.posexplode(F.try_variant_get("j", path, "array<variant>")).alias("line", name))


def get(c: str | Column, *paths: str, kind: str = "string") -> Column:
    """The first value among paths that is there and has the kind."""
    return F.coalesce(*[F.try_variant_get(c, p, kind) for p in paths])


def word(c: str | Column, *paths: str) -> Column:
    """The first text among paths that isn't blank, trimmed."""
    return F.coalesce(*[text.blank_to_null(F.try_variant_get(c, p, "string")) for p in paths])


def count(c: str | Column, *paths: str) -> Column:
    return numbers.non_negative_int(get(c, *paths))


def timestamp_of(c: Column) -> Column:
    """A time in UTC from text: ISO 8601, without offset as UTC, or Unix seconds (up to 1e10) or milliseconds; small numbers are none."""
    t = F.trim(c)
    number = t.try_cast("double")
    ms = F.when(F.abs(number) < 1e8, None).when(F.abs(number) <= 1e10, number * 1000).otherwise(number)
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    by_number = epoch + F.make_dt_interval(secs=(F.floor(ms) / 1000).cast("decimal(18,6)"))
    zone = r"(?i)(Z|[+-]\d{2}:?\d{2})$"
    plain = F.to_timestamp_ntz(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?" + zone[4:]), F.regexp_replace(F.regexp_replace(t, zone, ""), " ", "T")).otherwise(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"), F.regexp_replace(t, " ", "T"))))
    offset = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 0)
    minutes = F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int"))
    shifted = F.when(t.rlike(r"\d:?\d{2}.*[+-]\d{2}:?\d{2}$"), plain - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))).otherwise(plain)
    return F.when(number.isNotNull(), by_number).otherwise(shifted)


def first_time(c: str | Column, *paths: str) -> Column:
    return F.coalesce(*[timestamp_of(get(c, p)) for p in paths])


def session_of(file: Column) -> Column:
    """A file's name without its endings."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.(jsonl\.zst|jsonl|json|settings\.json|db)$", "")


FIELDS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens"]


def usage_rows(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Normalized usage rows and `reject`, the reason why a row is no event, null for good ones.

    Missing token columns are 0. The total is the declared one if above 0, else the sum of input,
    output and cache tokens. One-hour writes are a part of cache writes, reasoning one of output.
    """
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("string")
    c = {k: columns.get(k, zero) for k in FIELDS}
    # the place in a file has to stay comparable within it
    index = columns.get("event_index", F.lit(0).cast("bigint"))
    wide = df.select(
        F.lit(source).alias("source"), text.blank_to_null(columns["session_id"]).alias("session_id"), columns["ts"].alias("ts"),
        text.blank_to_null(columns.get("repo_root", none)).alias("repo_root"), text.billing_provider(columns.get("provider", none)).alias("provider"),
        text.model_name(columns.get("model", none)).alias("model"), *[v.cast("bigint").alias(k) for k, v in c.items()],
        columns.get("total_tokens", zero).cast("bigint").alias("_declared"), columns.get("single_request", F.lit(None).cast("boolean")).alias("single_request"),
        columns.get("cost_usd", F.lit(None).cast("double")).alias("cost_usd"), columns.get("machine", none).alias("machine"),
        columns.get("message_id", none).alias("message_id"), columns.get("request_id", none).alias("request_id"), columns.get("file", F.col("file")).alias("file"), index.alias("event_index"),
    )
    wide = wide.withColumns({"cache_write_1h_tokens": F.least("cache_write_1h_tokens", "cache_write_tokens"), "cost_mode": F.when(F.col("cost_usd").isNotNull(), "explicit").otherwise("estimated")})
    parts = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    wide = wide.withColumn("total_tokens", F.when(F.col("_declared") > 0, F.col("_declared")).otherwise(parts))
    signal = (F.col("total_tokens") > 0) | (F.col("reasoning_tokens") > 0) | (F.coalesce("cost_usd", F.lit(0.0)) > 0)
    big = F.greatest("total_tokens", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens") > MOST_TOKENS
    reject = F.when(~signal, "no_token_usage").when(F.col("ts").isNull(), "invalid_timestamp").when(F.col("session_id").isNull() | big, "event_creation_failed")
    # fixed values: the reasons are those that reports of skipped rows name
    order = ["source", "session_id", "ts", "repo_root", "provider", "model", *FIELDS, "total_tokens", "single_request", "cost_usd", "cost_mode", "machine", "message_id", "request_id", "file", "event_index"]
    return wide.withColumn("reject", reject).select(*order, "reject")


def good(rows: DataFrame) -> DataFrame:
    return rows.where("reject is null").drop("reject")


def skipped(rows: DataFrame) -> DataFrame:
    """(source, file, reason, rows) of what was left out."""
    return rows.where("reject is not null").groupBy("source", "file", F.col("reject").alias("reason")).agg(F.count("*").alias("rows"))


def malformed(df: DataFrame, source: str) -> DataFrame:
    return df.where("j is null").groupBy(F.lit(source).alias("source"), "file").agg(F.lit("json_parse_error").alias("reason"), F.count("*").alias("rows"))
