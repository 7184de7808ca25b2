"""The share report: cube cells and sessions under filters, roll-ups, matrices, tables, stand-in names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import epoch_ms, from_ms, iso_week, local, period_key
from quillmeter.functions.numbers import money_sum
from quillmeter.functions.ranges import period_range, shift
from quillmeter.functions.text import UNATTRIBUTED, key_segments, project_key
from quillmeter.operators.reports import agent_time
from quillmeter.operators.totals import totals
from quillmeter.operators.windows import BLOCK_MS, HOUR_MS, active_gaps, events_in_blocks, split_steps, step_key, union_length
from quillmeter.schema import LOCAL, TOKENS

DIMENSIONS = ["source", "model", "project", "machine"]
UNKNOWN_MODEL = "(unknown)"
#: Days before the window's end that keep hourly cells where the payload is too large, and sessions kept a project.
HOURLY_DAYS, SESSIONS = 90, 200


def label_ranks(usage: DataFrame, label: str) -> DataFrame:
    """(label, total_tokens, rank): labels by tokens, then by name."""
    sums = usage.groupBy(label).agg(F.sum("total_tokens").alias("total_tokens"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_tokens").desc(), label)).cast("bigint"))


def source_rank(source: Column, order: list[str]) -> list[Column]:
    """Sort columns: sources in the registry's order, then others by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), source) if order else F.lit(0)
    return [F.when(place > 0, place).otherwise(F.lit(len(order) + 1)), source]


def path_name(value: Column) -> Column:
    """The last folder of a path, ~ where the path is a user's home."""
    home = value.rlike(r"^(?:/home/[^/]+|/Users/[^/]+|/root|[A-Za-z]:[\\/]Users[\\/][^\\/]+)[\\/]*$")
    return F.when(home, "~").otherwise(F.coalesce(F.try_element_at(key_segments(value), F.lit(-1)), value))


def model_label(model: Column) -> Column:
    """A model as it is shown: one that is a path by its last part, none as unknown."""
    shaped = model.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/|~|\.{1,2}[\\/])") | model.rlike(r":(?:[A-Za-z]:[\\/]|/(?!/)|~)")
    tail = F.when(model.rlike(r"^[A-Za-z]:[\\/]") | ~model.contains(":"), model).otherwise(F.regexp_replace(model, r"^[^:]*:", ""))
    return F.when(model.isNull(), UNKNOWN_MODEL).when(shaped, path_name(tail)).otherwise(model)


def redaction(usage: DataFrame, label: str, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """(label, shown): stand-ins prefix-1, prefix-2 … by tokens; labels in keep name no one and stay."""
    kept = F.col(label).isin(keep or [])
    ranks = label_ranks(usage.where(~kept), label).select(label, F.concat(F.lit(prefix + "-"), F.col("rank").cast("string")).alias("shown"))
    return ranks.unionByName(usage.where(kept).select(label, F.col(label).alias("shown")).distinct())


def replace_names(text: Column, names: dict[str, str]) -> Column:
    """text with whole-word mentions of names replaced, longest first, nothing replaced twice; names are the few of a report."""
    known = sorted(((k, v) for k, v in names.items() if k != v and any(c.isalnum() for c in k)), key=lambda x: (-len(x[0]), x[0]))
    if not known:
        return text
    # marks of the private-use area stand for names until all are found
    out = text
    for i, (name, _) in enumerate(known):
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_-]){re.escape(name)}(?![\p{{L}}\p{{N}}_-])", f"\ue000{i}\ue001")
    for i, (_, shown) in enumerate(known):
        out = F.replace(out, F.lit(f"\ue000{i}\ue001"), F.lit(shown))
    return out


def scrub_paths(text: Column, known: dict[str, str]) -> Column:
    """text without paths: known ones become their stand-in, longest first, homes ~, any other its last folder."""
    out = text
    for path, shown in sorted(known.items(), key=lambda x: (-len(x[0]), x[0])):
        if path:
            out = F.replace(out, F.lit(path), F.lit(shown))
    out = F.regexp_replace(out, r"(?:/home/|/Users/|[A-Za-z]:[\\/]Users[\\/])[^\\/\s\"'`<>|]+", "~")
    start, word = r"(^|[\s\"'`(\[{<=,;|>])", r"[^\s\"'`<>()\[\]{},;|/\\]"
    other = rf"{start}(?:[A-Za-z]:|~|\.{{1,2}})?(?:[\\/]{word}+)*[\\/]({word}+)[\\/]?"
    return F.regexp_replace(out, other, "$1$2")


def cube(usage: DataFrame, tz: str = "UTC", hourly_from: str | None = None) -> DataFrame:
    """Cells by period, source, model, project and machine with agent time; a period is an hour, or a day before hourly_from."""
    rows = usage.withColumns({"model": model_label(F.col("model")), "project": F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)), "machine": F.coalesce("machine", F.lit(LOCAL))})
    cost = lambda mode: money_sum(F.when(F.col("cost_mode") == mode, F.col("cost_usd"))).alias(f"{mode}_usd")

    def cells(part: DataFrame, unit: str) -> DataFrame:
        sums = part.withColumn("period", period_key(F.col("ts"), unit, tz)).groupBy("period", *DIMENSIONS).agg(F.count("*").alias("events"), *totals(), cost("explicit"), cost("estimated"))
        return sums

    def timed(unit: str) -> DataFrame:
        return agent_time(rows, unit, tz, DIMENSIONS)

    if hourly_from is None:
        return cells(rows, "hour").join(timed("hour"), ["period", *DIMENSIONS])
    day = period_key(F.col("ts"), "day", tz)
    old = cells(rows.where(day < hourly_from), "day").join(timed("day").where(F.col("period") < hourly_from), ["period", *DIMENSIONS])
    new = cells(rows.where(day >= hourly_from), "hour").join(timed("hour").where(F.substring("period", 1, 10) >= hourly_from), ["period", *DIMENSIONS])
    return old.unionByName(new)


def payload(usage: DataFrame, window_end: str, target: int, tz: str = "UTC") -> tuple[DataFrame, str | None]:
    """(cells, hourly_from): hourly cells, or daily ones where they are older than 90 days and hourly ones would exceed target bytes."""
    hourly = cube(usage, tz)
    size = hourly.agg(F.sum(F.char_length(F.to_json(F.struct(*hourly.columns)))).alias("n")).first()["n"] or 0
    start = shift(window_end, -HOURLY_DAYS)
    if size <= target or usage.where(period_key(F.col("ts"), "day", tz) < start).isEmpty():
        return hourly, None
    return cube(usage, tz, start), start


def select_cells(cells: DataFrame, since: str | None = None, until: str | None = None, **members: list[str]) -> DataFrame:
    """Cells on dates since..until whose dimensions are among the members given; no members keep all."""
    day = F.substring("period", 1, 10)
    if since:
        cells = cells.where(day >= since)
    if until:
        cells = cells.where(day <= until)
    for dimension, values in members.items():
        if values:
            cells = cells.where(F.col(dimension).isin(values))
    return cells


def cell_total(cells: DataFrame) -> DataFrame:
    """One row: the sums over cells; the cost is null where no cell has one."""
    return cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in [*TOKENS, "events", "agent_ms"]], money_sum(F.col("cost_usd")).alias("cost_usd"), F.coalesce(F.bool_or("cost_incomplete"), F.lit(False)).alias("cost_incomplete"))


def hourly_cells(cells: DataFrame) -> DataFrame:
    """Cells with an hour."""
    return cells.where(F.char_length("period") > 10)


def period_active(usage: DataFrame, tz: str = "UTC", unit: str = "hour") -> DataFrame:
    """(period, active_ms): wall-clock activity of all usage by period, which cells can't be summed to."""
    steps = union_length(split_steps(active_gaps(usage, ["source", "session_id"])).select("step", "start_ms", "end_ms"), [])
    return steps.groupBy(step_key(unit, tz).alias("period")).agg(F.sum("active_ms").alias("active_ms"))


def active_sum(cells: DataFrame, active: DataFrame) -> DataFrame:
    """One row: activity of the periods that cells fall in, each period once."""
    return cells.select("period").distinct().join(active, "period").agg(F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"))


def rollup_by_period(cells: DataFrame, unit: str) -> DataFrame:
    """(key, sums) by hour, day, week or month in order of keys; daily cells have no hour and are left out there."""
    day = F.substring("period", 1, 10)
    key = {"hour": F.col("period"), "day": day, "week": iso_week(day.cast("date")), "month": F.substring("period", 1, 7)}[unit]
    rows = hourly_cells(cells) if unit == "hour" else cells
    return rows.groupBy(key.alias("key")).agg(F.sum("events").alias("events"), F.sum("total_tokens").alias("total_tokens"), F.sum("agent_ms").alias("agent_ms"), money_sum(F.col("cost_usd")).alias("cost_usd"))


def period_axis(cells: DataFrame, since: str, until: str, unit: str, hourly_from: str | None = None) -> DataFrame:
    """(period) every key of a view, also without data; hours begin where hourly cells do."""
    if unit == "hour" and hourly_from and hourly_from > since:
        since = hourly_from
    return period_range(cells.sparkSession, since, until, unit)


def sessions(usage: DataFrame, tz: str = "UTC", cap: int = SESSIONS) -> tuple[DataFrame, DataFrame]:
    """(rows, omitted): the newest `cap` sessions of each project with a label, and how many more each project has.

    A label is the source and the local start; those that are alike are numbered from the earliest.
    """
    rows = usage.withColumns({"model": model_label(F.col("model")), "machine": F.coalesce("machine", F.lit(LOCAL)), "_ms": epoch_ms(F.col("ts"))})
    root = F.min(F.when(F.col("repo_root").isNotNull(), F.struct("ts", "repo_root")))["repo_root"]
    one = rows.groupBy("source", "session_id").agg(F.coalesce(project_key(root), F.lit(UNATTRIBUTED)).alias("project"), F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"), F.count("*").alias("events"), F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("machine")).alias("machines"), *totals())
    newest = Window.partitionBy("project").orderBy(F.col("last_ms").desc(), F.col("first_ms").desc(), "source", "session_id")
    one = one.withColumn("_n", F.row_number().over(newest))
    omitted = one.where(F.col("_n") > cap).groupBy("project").agg(F.count("*").alias("count"))
    kept = one.where(F.col("_n") <= cap).drop("_n")
    base = F.concat("source", F.lit(" · "), F.date_format(local(from_ms(F.col("first_ms")), tz), "yyyy-MM-dd HH:mm"))
    kept = kept.withColumn("_base", base)
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("first_ms", "last_ms", "source", "session_id"))
    label = F.when(nth == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" #"), nth.cast("string")))
    return kept.withColumn("label", label).drop("_base"), omitted


def select_sessions(rows: DataFrame, since: str | None = None, until: str | None = None, source: list[str] | None = None, project: list[str] | None = None, models: list[str] | None = None, machines: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Sessions that were active on some date since..until, of a kept source and project, with a kept model and machine."""
    day = lambda c: F.date_format(local(from_ms(F.col(c)), tz), "yyyy-MM-dd")
    if since:
        rows = rows.where(day("last_ms") >= since)
    if until:
        rows = rows.where(day("first_ms") <= until)
    for column, values in (("source", source), ("project", project)):
        if values:
            rows = rows.where(F.col(column).isin(values))
    for column, values in (("models", models), ("machines", machines)):
        if values:
            rows = rows.where(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])))
    return rows


def omitted_count(omitted: DataFrame, project: str | None = None) -> DataFrame:
    """One row: sessions beyond the cap, in all or of one project."""
    rows = omitted.where(F.col("project") == project) if project is not None else omitted
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("omitted"))


def sort_rows(df: DataFrame, key: str, descending: bool = False, label: str = "label") -> DataFrame:
    """Rows by a column, empty cells last either way, equal ones by label."""
    value = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return df.orderBy(value, F.col(label))


def paginate(df: DataFrame, page: int, size: int) -> tuple[DataFrame, int, int, int]:
    """(rows, page, pages, count): a page of sorted rows; a page out of range is the nearest one."""
    size = max(1, int(size))
    count = df.count()
    pages = max(1, -(-count // size))
    page = min(max(page, 0), pages - 1)
    return df.offset(page * size).limit(size), page, pages, count


def block_matrix(usage: DataFrame, found: DataFrame, since: str, until: str, tz: str = "UTC", source: list[str] | None = None) -> DataFrame:
    """(day, hour, blocks, total_tokens) by the local day and hour that blocks of found(source, block_start_ms) start.

    A block counts where it runs into the dates, so a day before them can come up; of a block that
    runs past their end, only usage up to that end counts.
    """
    if source:
        found, usage = found.where(F.col("source").isin(source)), usage.where(F.col("source").isin(source))
    at = lambda ms: local(from_ms(ms), tz)
    shown = found.withColumns({"_start": at(F.col("block_start_ms")), "_end": at(F.col("block_start_ms") + BLOCK_MS - 1)})
    shown = shown.where((F.date_format("_end", "yyyy-MM-dd") >= since) & (F.date_format("_start", "yyyy-MM-dd") <= until))
    shown = shown.select("source", "block_start_ms", F.date_format("_start", "yyyy-MM-dd").alias("day"), F.hour("_start").cast("bigint").alias("hour"))
    rows = events_in_blocks(usage, shown).where(period_key(F.col("ts"), "day", tz) <= until)
    hours = F.sequence(F.lit(0), F.lit(BLOCK_MS // HOUR_MS - 1))
    held = shown.select("source", "block_start_ms", F.explode(F.transform(hours, lambda i: (F.col("block_start_ms") + i * HOUR_MS).cast("bigint"))).alias("hour_ms"))
    own = rows.withColumn("hour_ms", (F.floor(epoch_ms(F.col("ts")) / HOUR_MS) * HOUR_MS).cast("bigint")).join(held, ["source", "hour_ms"]).groupBy("source", "block_start_ms").agg(F.sum("total_tokens").alias("t"))
    out = shown.join(own, ["source", "block_start_ms"], "left")
    return out.groupBy("day", "hour").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"))
