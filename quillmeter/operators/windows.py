"""Operators that follow rows in time: active time, blocks, streaks, spikes, levels, running cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import day_start_utc, dense_days, epoch_ms, from_ms, in_local_window, local, period_key
from quillmeter.functions.numbers import median, money_sum
from quillmeter.operators.totals import totals

IDLE_MS = 5 * 60 * 1000
HOUR_MS = 3_600_000
BLOCK_MS = 5 * HOUR_MS


def active_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_ms, end_ms): gaps between neighbours of a group that count as activity."""
    order = Window.partitionBy(*keys).orderBy("end_ms")
    rows = df.select(*keys, epoch_ms(F.col("ts")).alias("end_ms")).withColumn("start_ms", F.lag("end_ms").over(order))
    return rows.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= IDLE_MS))


def active_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """Active milliseconds by group; groups of one row have 0."""
    sums = active_gaps(df, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("active_ms"))
    return df.select(*keys).distinct().join(sums, keys, "left").withColumn("active_ms", F.coalesce("active_ms", F.lit(0)).cast("bigint"))


#: Every zone's offset is a multiple of this, so no local day or hour begins within a step.
STEP_MS = 900_000


def split_steps(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """df with a row for each quarter of an hour that [start, end) meets: the part within it, and `step`."""
    steps = F.sequence(F.floor(F.col(start) / STEP_MS), F.floor((F.col(end) - 1) / STEP_MS))
    rows = df.where(F.col(end) > F.col(start)).withColumn("step", F.explode(steps))
    return rows.withColumns({start: F.greatest(F.col(start), F.col("step") * STEP_MS).cast("bigint"), end: F.least(F.col(end), (F.col("step") + 1) * STEP_MS).cast("bigint")})


def step_key(unit: str = "day", tz: str = "UTC"):
    """The local period of a step."""
    return period_key(from_ms(F.col("step") * STEP_MS), unit, tz)


def union_length(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, active_ms): the time that parts(keys, step, start_ms, end_ms) cover, overlaps once."""
    before = Window.partitionBy(*keys, "step").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("reach", F.max("end_ms").over(before))
    fresh = F.greatest(F.lit(0), F.col("end_ms") - F.greatest("start_ms", F.coalesce("reach", F.col("start_ms"))))
    return seen.groupBy(*keys, "step").agg(F.sum(fresh).cast("bigint").alias("active_ms"))


def union_active_time(df: DataFrame, session: list[str], tz: str = "UTC") -> DataFrame:
    """(day, active_ms): wall-clock activity by local day, sessions that overlap counted once.

    Gaps are cut at quarters of an hour before they merge, so a quarter is a group of its own and
    no task needs a day, let alone all of time.
    """
    steps = union_length(split_steps(active_gaps(df, session)).select("step", "start_ms", "end_ms"), [])
    return steps.groupBy(step_key("day", tz).alias("day")).agg(F.sum("active_ms").alias("active_ms"))


def active_time_by(usage: DataFrame, group, unit: str = "day", tz: str = "UTC") -> DataFrame:
    """(period, group, active_ms) and, with a null group and `combined`, the union over all groups.

    group is any expression of a row. A session is cut into runs of neighbours in one group; the
    gap at a switch counts for neither. Every period and group with an event has a row.
    """
    rows = usage.select("source", "session_id", "event_index", group.alias("group"), period_key(F.col("ts"), unit, tz).alias("period"), epoch_ms(F.col("ts")).alias("end_ms"))
    order = Window.partitionBy("source", "session_id").orderBy("end_ms", "event_index")
    rows = rows.withColumns({"start_ms": F.lag("end_ms").over(order), "_before": F.lag("group").over(order)})
    gaps = rows.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= IDLE_MS))
    parts = split_steps(gaps.select("group", "start_ms", "end_ms", F.col("group").eqNullSafe(F.col("_before")).alias("_same")))
    one = union_length(parts.where("_same").select("group", "step", "start_ms", "end_ms"), ["group"]).groupBy(step_key(unit, tz).alias("period"), "group").agg(F.sum("active_ms").alias("ms"))
    whole = union_length(parts.select("step", "start_ms", "end_ms"), []).groupBy(step_key(unit, tz).alias("period")).agg(F.sum("active_ms").alias("ms"))
    seen = rows.select("period", "group").distinct()
    same = (F.col("s.period") == F.col("o.period")) & F.col("s.group").eqNullSafe(F.col("o.group"))
    groups = seen.alias("s").join(one.alias("o"), same, "left").select("s.period", "s.group", F.coalesce("o.ms", F.lit(0)).cast("bigint").alias("active_ms"), F.lit(False).alias("combined"))
    days = seen.select("period").distinct().join(whole, "period", "left").select("period", F.lit(None).cast(dict(seen.dtypes)["group"]).alias("group"), F.coalesce("ms", F.lit(0)).cast("bigint").alias("active_ms"), F.lit(True).alias("combined"))
    return groups.unionByName(days)


def block_hours(usage: DataFrame, keys: list[str] | None = None, context: DataFrame | None = None, range_start_ms: int | None = None) -> DataFrame:
    """(keys, hour_ms, block_start_ms, uncertain): the five-hour block that each hour with events lies in.

    A gap of five hours or more ends any block, so stretches between such gaps are independent.
    Within one, the next block starts at the first event five hours after the last start. Starts
    are whole hours, so all events of an hour share a block, and only hours, with their first and
    last event, are put in order; a fold over a stretch's hours decides. Rows of context are
    placed like those of usage, for keys that usage has. A block of the first stretch is
    uncertain if it may have begun before range_start_ms, the start of what was read.
    """
    keys = keys or ["source"]
    hour = lambda: (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint").alias("hour_ms")
    by_hour = lambda df: df.groupBy(*keys, hour()).agg(F.min(epoch_ms(F.col("ts"))).alias("first"), F.max(epoch_ms(F.col("ts"))).alias("last"))
    hours = by_hour(usage)
    if context is not None:
        other = by_hour(context).join(hours.select(*keys).distinct(), keys, "left_semi")
        hours = hours.unionByName(other).groupBy(*keys, "hour_ms").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    by_time = Window.partitionBy(*keys).orderBy("hour_ms")
    hours = hours.withColumn("_cut", F.when(F.col("first") - F.lag("last").over(by_time) >= BLOCK_MS, 1).otherwise(0))
    hours = hours.withColumns({"_stretch": F.sum("_cut").over(by_time.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.min("first").over(Window.partitionBy(*keys))})
    lists = hours.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list("hour_ms")).alias("h"))
    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def step(acc, x):
        fresh = acc["at"].isNull() | (x >= acc["at"] + BLOCK_MS)
        return F.when(fresh, F.struct(x.alias("at"), F.concat(acc["all"], F.array(x)).alias("all"))).otherwise(acc)

    starts = lists.select(*keys, F.explode(F.aggregate("h", start, step, lambda a: a["all"])).alias("hour_ms")).withColumn("_start", F.col("hour_ms"))
    placed = hours.join(starts, [*keys, "hour_ms"], "left")
    own = F.last("_start", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    uncertain = F.lit(False) if range_start_ms is None else (F.col("_stretch") == 0) & (F.col("_first") - range_start_ms < BLOCK_MS)
    return placed.select(*keys, "hour_ms", own.alias("block_start_ms"), uncertain.alias("uncertain"))


def block_starts(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """usage with block_start_ms: five-hour blocks that begin at the hour of their first event; see block_hours."""
    keys = keys or ["source"]
    rows = usage.withColumn("hour_ms", (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint"))
    return rows.join(block_hours(usage, keys), [*keys, "hour_ms"]).select(*usage.columns, "block_start_ms")


def blocks(usage: DataFrame, context: DataFrame | None = None, since_ms: int | None = None, range_start_ms: int | None = None) -> DataFrame:
    """One row a block: source, start, end, first and last event, count, totals.

    With context or a range (see block_hours), also start_uncertain; blocks that end by since_ms
    are left out, and so are those that only context has events in.
    """
    rows = usage.withColumns({"_ms": epoch_ms(F.col("ts")), "hour_ms": (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint")})
    found = rows.join(block_hours(usage, ["source"], context, range_start_ms), ["source", "hour_ms"])
    more = [F.bool_or("uncertain").alias("start_uncertain")] if context is not None or range_start_ms is not None else []
    out = found.groupBy("source", "block_start_ms").agg((F.first("block_start_ms") + BLOCK_MS).alias("block_end_ms"), F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"), F.count("*").alias("events"), *more, *totals())
    return out if since_ms is None else out.where(F.col("block_end_ms") > since_ms)


def recent_blocks(found: DataFrame, count: int = 20) -> DataFrame:
    """The `count` latest blocks in time order."""
    return found.orderBy(F.col("block_start_ms").desc(), F.col("source").desc()).limit(count).orderBy("block_start_ms", "source")


def chain_start(usage: DataFrame, since_ms: int) -> DataFrame:
    """(source, chain_ms): the last event at or before since_ms that follows a gap of five hours; the first event without one."""
    by_time = Window.partitionBy("source").orderBy("hour_ms")
    hours = usage.groupBy("source", (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint").alias("hour_ms")).agg(F.min(epoch_ms(F.col("ts"))).alias("first"), F.max(epoch_ms(F.col("ts"))).alias("last"))
    hours = hours.withColumn("_gap", F.col("first") - F.lag("last").over(by_time))
    after = F.max(F.when((F.col("_gap") >= BLOCK_MS) & (F.col("first") <= since_ms), F.col("first")))
    return hours.groupBy("source").agg(F.coalesce(after, F.min("first")).alias("chain_ms"))


def events_in_blocks(usage: DataFrame, shown: DataFrame) -> DataFrame:
    """usage rows that lie in one of the blocks shown(source, block_start_ms)."""
    hours = F.sequence(F.lit(0), F.lit(BLOCK_MS // HOUR_MS - 1))
    held = shown.select("source", F.explode(F.transform(hours, lambda i: (F.col("block_start_ms") + i * HOUR_MS).cast("bigint"))).alias("hour_ms")).distinct()
    rows = usage.withColumn("hour_ms", (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint"))
    return rows.join(held, ["source", "hour_ms"], "left_semi").select(*usage.columns)


def ranked_blocks(found: DataFrame, count: int) -> DataFrame:
    """The `count` largest blocks: by cost, or by tokens if any block's cost isn't fully known."""
    whole = Window.partitionBy(F.lit(0))
    unknown = F.bool_or(F.col("cost_incomplete") | F.col("cost_usd").isNull()).over(whole)
    value = F.when(F.col("_unknown"), F.col("total_tokens").cast("double")).otherwise(F.col("cost_usd"))
    return found.withColumn("_unknown", unknown).orderBy(value.desc(), "block_start_ms", "source").drop("_unknown").limit(count)


def burn_rate(found: DataFrame, now_ms: int) -> DataFrame:
    """Blocks that are active now, with the minutes they have left, and tokens and cost an hour since their start, of a minute at least."""
    active = found.where((F.col("block_start_ms") <= now_ms) & (F.col("block_end_ms") > now_ms))
    hours = F.greatest(F.lit(now_ms) - F.col("block_start_ms"), F.lit(60_000)) / HOUR_MS
    left = F.ceil((F.col("block_end_ms") - now_ms) / 60_000).cast("bigint")
    return active.withColumns({"remaining_minutes": left, "tokens_per_hour": F.round(F.col("total_tokens") / hours).cast("bigint"), "cost_usd_per_hour": F.round(F.col("cost_usd") / hours, 12)})


def streaks(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive days in days(keys, day)."""
    keys = keys or []
    d = days.select(*keys, F.col("day").cast("date").alias("d")).distinct()
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("d")
    runs = d.withColumn("run", F.date_sub("d", F.row_number().over(order)))
    return runs.groupBy(*keys, "run").agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"), F.count("*").alias("length")).drop("run")


def longest_streak(days: DataFrame, keys: list[str]) -> DataFrame:
    return streaks(days, keys).groupBy(*keys).agg(F.max("length").alias("longest"))


def current_streak(days: DataFrame, today: str, keys: list[str]) -> DataFrame:
    """The run that holds today or, failing that, yesterday; 0 without one."""
    runs = streaks(days, keys)
    live = (F.col("first") <= today) & (F.col("last") >= F.date_format(F.date_sub(F.lit(today).cast("date"), 1), "yyyy-MM-dd"))
    length = F.when(live, F.datediff(F.least(F.col("last").cast("date"), F.lit(today).cast("date")), F.col("first").cast("date")) + 1).otherwise(0)
    return runs.groupBy(*keys).agg(F.max(length).cast("bigint").alias("current"))


def daily(usage: DataFrame, tz: str = "UTC", keys: list[str] | None = None) -> DataFrame:
    day = F.date_format(local(F.col("ts"), tz), "yyyy-MM-dd").alias("day")
    return usage.groupBy(*(keys or []), day).agg(*totals())


def spend_spikes(usage: DataFrame, tz: str = "UTC", least: float = 1.0, times: float = 3.0, active: int = 3, span: int = 28, since: str | None = None, until: str | None = None) -> DataFrame:
    """(day, cost_usd, median_usd): days that cost `least` or more and `times` the median of the active days before.

    Of the `span` days before, those with cost are active; there have to be `active` of them.
    Dates given bound the days that are read.
    """
    costs = daily(usage.where(in_local_window(F.col("ts"), since, until, tz)), tz).select("day", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))
    dense = dense_days(costs).join(costs, "day", "left").fillna(0.0, ["cost_usd"])
    frame = Window.orderBy("day").rowsBetween(-span, -1)
    found = dense.withColumn("_b", F.filter(F.collect_list("cost_usd").over(frame), lambda c: c > 0)).withColumn("median_usd", median(F.col("_b")))
    return found.where((F.col("cost_usd") >= least) & (F.size("_b") >= active) & (F.col("cost_usd") >= times * F.col("median_usd"))).select("day", "cost_usd", "median_usd")


def activity_levels(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """(day, total_tokens, level): every day with its level 0-4 by quartiles of active days (index of the sorted values)."""
    sums = daily(usage, tz).select("day", "total_tokens")
    dense = dense_days(sums).join(sums, "day", "left").fillna(0, ["total_tokens"])
    values = sums.where("total_tokens > 0").agg(F.array_sort(F.collect_list("total_tokens")).alias("v"))
    at = lambda q: F.coalesce(F.try_element_at(F.col("v"), (F.floor(q * (F.size("v") - 1)) + 1).cast("int")), F.lit(0))
    limits = values.select(*[at(q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    t = F.col("total_tokens")
    level = F.when(t <= 0, 0).when(t <= F.col("q0"), 1).when(t <= F.col("q1"), 2).when(t <= F.col("q2"), 3).otherwise(4)
    return dense.crossJoin(F.broadcast(limits)).select("day", t.cast("bigint").alias("total_tokens"), level.cast("bigint").alias("level"))


def trends(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """Every day from the first to the last with tokens, cost, and whether there was usage."""
    sums = daily(usage, tz).select("day", "total_tokens", "cost_usd", "cost_incomplete")
    out = dense_days(sums).join(sums, "day", "left")
    return out.select("day", F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("cost_incomplete", F.lit(False)).alias("cost_incomplete"), F.col("total_tokens").isNotNull().alias("observed"))


def running_cost(usage: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """usage with the cost so far and whether any of it is unknown."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumns({"running_usd": F.sum(F.col("cost_usd").cast("decimal(38,12)")).over(so_far).cast("double"), "running_incomplete": F.bool_or(F.col("cost_usd").isNull()).over(so_far)})


def month_end_projection(usage: DataFrame, now: str, least_days: float = 3.0, tz: str = "UTC") -> DataFrame:
    """(month, cost_usd, projected_usd): the local month's cost so far over its elapsed days times its days.

    The part of today that has passed is measured on that day's own length, 23 to 25 hours where
    the clock changes.
    """
    at = F.lit(now).cast("timestamp_ntz")
    here = local(at, tz)
    first = F.date_trunc("month", here).cast("date")
    today = here.cast("date")
    start, midnight, tomorrow = (day_start_utc(d, tz) for d in (first, today, F.date_add(today, 1)))
    spent = usage.where((F.col("ts") >= start) & (F.col("ts") <= at)).agg(money_sum(F.col("cost_usd")).alias("cost_usd"))
    elapsed = F.datediff(today, first) + (epoch_ms(at) - epoch_ms(midnight)) / (epoch_ms(tomorrow) - epoch_ms(midnight))
    return spent.select(F.date_format(here, "yyyy-MM").alias("month"), "cost_usd", F.when(elapsed >= least_days, F.col("cost_usd") / elapsed * F.day(F.last_day(here))).alias("projected_usd"))
