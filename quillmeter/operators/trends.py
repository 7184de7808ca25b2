"""Series over days: cost, tokens or active hours, in all, by source and by project, with gaps and spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import period_key
from quillmeter.functions.numbers import money_sum
from quillmeter.functions.ranges import period_range, shift
from quillmeter.functions.text import UNATTRIBUTED, project_key
from quillmeter.operators.windows import active_time_by, spend_spikes

METRICS = ("cost", "tokens", "active-hours")


def project(usage: DataFrame) -> Column:
    return F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED))


def daily_values(usage: DataFrame, metric: str = "cost", by: Column | None = None, tz: str = "UTC") -> DataFrame:
    """(day, series, value, incomplete): a metric by local day and, where `by` is given, by its value.

    Cost without a price counts 0 and makes the day incomplete. Active time is in milliseconds;
    in all, sessions that overlap count once, so it is less than the sum over series.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    series = F.lit("combined") if by is None else by
    if metric == "active-hours":
        found = active_time_by(usage, series, "day", tz).where("combined" if by is None else "not combined")
        return found.select(F.col("period").alias("day"), F.coalesce("group", F.lit("combined")).alias("series"), F.col("active_ms").cast("double").alias("value"), F.lit(False).alias("incomplete"))
    day = period_key(F.col("ts"), "day", tz).alias("day")
    rows = usage.groupBy(day, series.alias("series"))
    if metric == "tokens":
        return rows.agg(F.sum("total_tokens").cast("double").alias("value"), F.lit(False).alias("incomplete"))
    return rows.agg(F.coalesce(money_sum(F.col("cost_usd")), F.lit(0.0)).alias("value"), F.bool_or(F.col("cost_usd").isNull()).alias("incomplete"))


def series(values: DataFrame, since: str, until: str) -> DataFrame:
    """(series, day, value, incomplete, observed): each series with a value between two dates, dense over them."""
    held = values.where(F.col("day").between(since, until))
    days = period_range(values.sparkSession, since, until).withColumnRenamed("period", "day")
    # the few series that there are, by each day of the window
    grid = held.select("series").distinct().withColumn("_a", F.lit(since)).join(days.withColumn("_a", F.lit(since)), "_a").drop("_a")
    out = grid.join(held, ["series", "day"], "left")
    return out.select("series", "day", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"), F.col("value").isNotNull().alias("observed"))


def summary(dense: DataFrame) -> DataFrame:
    """(series, total, average, peak_day, peak_value, incomplete, observed_days): figures of dense series; of equal peaks the first."""
    total = F.sum(F.col("value").cast("decimal(38,12)")).cast("double")
    peak = F.min(F.struct((-F.col("value")).alias("v"), F.col("day").alias("day")))
    out = dense.groupBy("series").agg(total.alias("total"), F.count("*").alias("_n"), peak.alias("_p"), F.bool_or("incomplete").alias("incomplete"), F.count_if("observed").alias("observed_days"))
    return out.select("series", "total", F.round(F.col("total") / F.col("_n"), 12).alias("average"), F.col("_p.day").alias("peak_day"), (-F.col("_p.v")).alias("peak_value"), "incomplete", "observed_days")


def by_source(usage: DataFrame, since: str, until: str, metric: str = "cost", tz: str = "UTC") -> DataFrame:
    return series(daily_values(usage, metric, F.col("source"), tz), since, until)


def by_project(usage: DataFrame, since: str, until: str, metric: str = "cost", tz: str = "UTC") -> DataFrame:
    """Series of projects with `rank`: the largest total first, then by name."""
    dense = series(daily_values(usage, metric, project(usage), tz), since, until)
    order = F.row_number().over(Window.orderBy(F.col("total").desc(), "series"))
    ranks = summary(dense).select("series", order.cast("bigint").alias("rank"))
    return dense.join(ranks, "series")


def mark_spikes(dense: DataFrame, usage: DataFrame, since: str, until: str, tz: str = "UTC", span: int = 28) -> DataFrame:
    """dense with `spike`: days whose cost is far above the days before, of which `span` are read before the window."""
    found = spend_spikes(usage, tz, span=span, since=shift(since, -span), until=until).where(F.col("day") >= since).select("day", F.lit(True).alias("spike"))
    return dense.join(found, "day", "left").withColumn("spike", F.coalesce("spike", F.lit(False)))
