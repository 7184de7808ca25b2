"""Calendar keys and dense calendars; all times are UTC without a zone and zones are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, independent of the session's zone."""
    seconds = (ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds * 1000).cast("bigint")


def from_ms(ms: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def local(ts: Column, tz: str = "UTC") -> Column:
    return ts if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def iso_week(day: Column) -> Column:
    """YYYY-Www of a date; the week belongs to the year of its Thursday."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def period_key(ts: Column, unit: str, tz: str = "UTC") -> Column:
    """The key of the local hour, day, ISO week or month."""
    at = local(ts, tz)
    if unit == "week":
        return iso_week(at.cast("date"))
    return F.date_format(at, {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])


def day_start_utc(day: Column, tz: str) -> Column:
    """The instant at which a local day begins; in a gap of the clock, the end of the gap."""
    return day.cast("timestamp_ntz") if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), day.cast("timestamp_ntz"))


def in_local_window(ts: Column, since: str | None, until: str | None, tz: str = "UTC") -> Column:
    """Local dates from since to until, both included, as bounds on ts itself, which scans can use."""
    test = F.lit(True)
    if since:
        test = test & (ts >= day_start_utc(F.lit(since).cast("date"), tz))
    if until:
        test = test & (ts < day_start_utc(F.date_add(F.lit(until).cast("date"), 1), tz))
    return test


def dense_days(df: DataFrame, day: str = "day", before: int = 0) -> DataFrame:
    """Every day between the first and the last day of df, `before` days earlier too, as YYYY-MM-DD."""
    ends = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence(F.date_sub("a", before), F.col("b"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias(day))


def days_between(spark: SparkSession, since: str, until: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def days_inclusive(first: Column, last: Column) -> Column:
    return F.datediff(last.cast("date"), first.cast("date")) + 1
