"""Reports composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import epoch_ms, in_local_window, local, period_key
from quillmeter.functions.numbers import delta_ratio, money_sum, ratio
from quillmeter.functions.text import UNATTRIBUTED, provider_of_model, project_key
from quillmeter.operators.totals import totals, with_cost_share
from quillmeter.operators.windows import IDLE_MS, active_time, daily, split_steps, step_key
from quillmeter.pricing.cost import cache_saving, estimated_cost, long_context_extra, prompt_tokens, with_rates
from quillmeter.schema import LOCAL, TOKENS


def sessions(usage: DataFrame) -> DataFrame:
    """One row a session: first and last time, duration, active time, events, models, cost by mode, totals."""
    ms = epoch_ms(F.col("ts"))
    cost = lambda mode: money_sum(F.when(F.col("cost_mode") == mode, F.col("cost_usd")))
    rows = usage.groupBy("source", "session_id").agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), cost("explicit").alias("explicit_usd"), cost("estimated").alias("estimated_usd"), *totals())
    return rows.withColumn("duration_ms", F.col("last_ms") - F.col("first_ms")).join(active_time(usage, ["source", "session_id"]), ["source", "session_id"])


def session_order() -> list:
    return [F.col("cost_usd").desc_nulls_last(), F.col("last_ms").desc(), F.col("session_id"), F.col("source")]


def sessions_by_repo(usage: DataFrame) -> DataFrame:
    rows = usage.withColumn("project", F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)))
    return rows.groupBy("project").agg(F.count_distinct("source", "session_id").alias("sessions"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("events"), *totals())


def projects(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row a project: totals, share of cost, events, active days, its three largest models."""
    rows = usage.withColumns({"project": F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)), "_day": F.to_date(local(F.col("ts"), tz))})
    sums = with_cost_share(rows.groupBy("project").agg(F.count("*").alias("events"), F.count_distinct("_day").alias("active_days"), *totals()))
    models = rows.where("model is not null").groupBy("project", "model").agg(F.sum("total_tokens").alias("t"), money_sum(F.col("cost_usd")).alias("c"), F.sum("input_tokens").alias("i"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("t").desc(), F.col("c").desc_nulls_last(), F.col("i").desc(), "model"))
    top = models.withColumn("r", rank).where("r <= 3").groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "model"))), lambda x: x["model"]), ",").alias("top_models"))
    return sums.join(top, "project", "left")


def tools(calls: DataFrame, by_source: bool = False) -> DataFrame:
    """One row a tool, names case-folded: calls, errors, unknown, rate of errors among known ones, sessions, display name."""
    keys = ["key", *(["source"] if by_source else [])]
    rows = calls.withColumn("key", F.lower("name"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_distinct("source", "session_id").alias("sessions"))
    names = rows.groupBy(*keys, "name").count().groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), "name"))["name"].alias("display_name"))
    known = F.col("calls") - F.col("unknown")
    return sums.join(names, keys).withColumn("error_rate", F.when(known > 0, F.col("errors") / known))


def tool_roots(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """The project most of a tool's calls were made in; none comes last on a tie."""
    rows = calls.join(roots, ["source", "session_id"], "left").withColumn("key", F.lower("name"))
    n = rows.groupBy("key", "root").count()
    return n.groupBy("key").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("root").isNull().alias("none"), "root"))["root"].alias("top_root"))


def window_summary(usage: DataFrame, since: str, until: str, tz: str = "UTC") -> DataFrame:
    """Totals, events and active days of local dates since..until, by source and in all (source null)."""
    day = F.date_format(local(F.col("ts"), tz), "yyyy-MM-dd")
    rows = usage.where(in_local_window(F.col("ts"), since, until, tz)).withColumn("_day", day)
    return rows.groupingSets([[F.col("source")], []], F.col("source")).agg(F.count("*").alias("events"), F.count_distinct("_day").alias("active_days"), *totals())


METRICS = [*TOKENS, "events", "active_days", "cost_usd"]


def compare(usage: DataFrame, now: tuple[str, str], before: tuple[str, str], keys: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Both windows side by side, in one pass: metrics of now and before by key; a side without usage is 0."""
    keys = keys or []
    day = F.date_format(local(F.col("ts"), tz), "yyyy-MM-dd")
    # one range over both windows reaches the scan
    rows = usage.where(in_local_window(F.col("ts"), min(now[0], before[0]), max(now[1], before[1]), tz)).withColumn("_day", day)
    side = F.when(F.col("_day").between(*now), "now").when(F.col("_day").between(*before), "before")
    rows = rows.withColumn("_side", side).where("_side is not null")
    out = []
    for s in ("now", "before"):
        mine = F.col("_side") == s
        out += [F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0)).cast("bigint").alias(f"{c}_{s}") for c in TOKENS]
        out += [F.count_if(mine).alias(f"events_{s}"), F.count_distinct(F.when(mine, F.col("_day"))).alias(f"active_days_{s}")]
        cost = money_sum(F.when(mine, F.col("cost_usd")))
        out.append(F.when(F.count_if(mine) == 0, 0.0).otherwise(cost).alias(f"cost_usd_{s}"))
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def compare_metrics(usage: DataFrame, now: tuple[str, str], before: tuple[str, str], tz: str = "UTC") -> DataFrame:
    """(metric, now, before, delta, ratio) of the nine metrics."""
    wide = compare(usage, now, before, tz=tz)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_now").cast("double").alias("now"), F.col(f"{m}_before").cast("double").alias("before")) for m in METRICS])
    long = wide.select(F.inline(rows))
    return long.withColumns({"delta": F.col("now") - F.col("before"), "ratio": F.round(delta_ratio(F.col("now"), F.col("before")), 9)})


def context_pressure(usage: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts of single requests by key: number, largest, over 200k, over 80 % of the model's limit, what tiers added."""
    rated = long_context_extra(with_rates(usage.where("single_request"), rates)).withColumn("_p", prompt_tokens())
    limit = F.col("rates.max_input_tokens")
    return rated.groupBy(*keys).agg(F.count("*").alias("requests"), F.max("_p").alias("max_prompt"), F.count_if(F.col("_p") > 200_000).alias("over_200k"), F.count_if(F.col("_p") > limit * 0.8).alias("near_limit"), F.round(F.sum(F.col("tier_extra").cast("decimal(38,12)")), 9).cast("double").alias("tier_extra_usd"))


def cache_savings(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """What reading from caches saved, in all; null where no row says."""
    return with_rates(usage, rates).agg(F.round(F.sum(cache_saving().cast("decimal(38,12)")), 9).cast("double").alias("saved_usd"), F.count_if(cache_saving().isNotNull()).alias("rows"))


def counterfactual(usage: DataFrame, rates: DataFrame, candidates: list[str], unit: str = "month", tz: str = "UTC") -> DataFrame:
    """Each period's totals at the base rates of each candidate model, against its own cost; cheapest first by rank.

    Totals are made first, so the product with the few candidates has a row a period and model.
    """
    keep = [*TOKENS, "cache_write_1h_tokens"]
    sums = usage.withColumn("period", period_key(F.col("ts"), unit, tz)).groupBy("period").agg(*[F.sum(c).alias(c) for c in keep], money_sum(F.col("cost_usd")).alias("baseline_usd")).withColumn("single_request", F.lit(False))
    table = rates.where(F.col("model_key").isin(candidates)).select(F.col("model_key").alias("candidate"), F.struct(*[c for c in rates.columns if c != "model_key"]).alias("rates"))
    rows = sums.crossJoin(F.broadcast(table.limit(len(candidates)))).withColumn("candidate_usd", F.round(estimated_cost(False), 9))
    whole = F.sum(F.col("candidate_usd").cast("decimal(38,12)")).over(Window.partitionBy("candidate"))
    rows = rows.withColumn("_all", whole)
    rank = F.dense_rank().over(Window.orderBy(F.col("_all").asc_nulls_last(), "candidate"))
    return rows.select("period", "candidate", "baseline_usd", "candidate_usd", F.round(F.col("baseline_usd") - F.col("candidate_usd"), 9).alias("savings_usd"), ratio(F.col("candidate_usd"), F.col("baseline_usd")).alias("cost_ratio"), rank.cast("bigint").alias("rank"))


def value_months(usage: DataFrame, plans: DataFrame, tz: str = "UTC", first: str | None = None, last: str | None = None) -> DataFrame:
    """Plans(plan, sources, monthly_usd) by calendar month, idle months too: cost of their sources, and how often it pays the plan.

    Months run from the first to the last with usage, or those of the dates given.
    """
    day = local(F.col("ts"), tz)
    ends = usage.agg(F.min(F.trunc(F.to_date(day), "month")).alias("a"), F.max(F.trunc(F.to_date(day), "month")).alias("b"))
    bound = lambda given, c: F.coalesce(F.trunc(F.lit(given).cast("date"), "month"), c) if given else F.col(c)
    months = ends.select(bound(first, "a").alias("a"), bound(last, "b").alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    one = plans.withColumn("source", F.explode("sources"))
    spent = usage.withColumn("month", period_key(F.col("ts"), "month", tz)).groupBy("month", "source").agg(F.sum(F.col("cost_usd").cast("decimal(38,12)")).alias("usd"), F.sum("total_tokens").alias("tokens"))
    used = spent.join(one.select("plan", "source"), "source").groupBy("month", "plan").agg(F.sum("usd").cast("double").alias("usd"), F.sum("tokens").alias("tokens"))
    grid = months.crossJoin(F.broadcast(plans.select("plan", "monthly_usd")))
    out = grid.join(used, ["month", "plan"], "left")
    return out.select("month", "plan", "monthly_usd", F.coalesce("usd", F.lit(0.0)).alias("usage_usd"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("total_tokens"), F.round(F.coalesce("usd", F.lit(0.0)) / F.col("monthly_usd"), 6).alias("value_ratio"))


def efficiency(usage: DataFrame, commits: DataFrame, unit: str = "month", tz: str = "UTC") -> DataFrame:
    """Usage and commits(ts, added, deleted) by period that has both: cost by commit and by 1,000 lines, tokens by commit."""
    u = usage.withColumn("period", period_key(F.col("ts"), unit, tz)).groupBy("period").agg(F.sum("total_tokens").alias("total_tokens"), money_sum(F.col("cost_usd")).alias("cost_usd"))
    c = commits.withColumn("period", period_key(F.col("ts"), unit, tz)).groupBy("period").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    out = u.join(c, "period")
    lines = F.col("added") + F.col("deleted")
    return out.withColumns({"usd_per_commit": ratio(F.col("cost_usd"), F.col("commits")), "usd_per_1k_lines": ratio(F.col("cost_usd") * 1000, lines), "tokens_per_commit": ratio(F.col("total_tokens"), F.col("commits")), "commits_per_usd": ratio(F.col("commits"), F.col("cost_usd"))})


def wrapped_top(usage: DataFrame, year: int, column: str, count: int = 5, tz: str = "UTC") -> DataFrame:
    """A year's largest values of a column, by cost, tokens, then name."""
    rows = usage.where(in_local_window(F.col("ts"), f"{year}-01-01", f"{year}-12-31", tz)).where(F.col(column).isNotNull())
    sums = rows.groupBy(F.col(column).alias("name")).agg(F.sum("total_tokens").alias("total_tokens"), money_sum(F.col("cost_usd")).alias("cost_usd"))
    return sums.orderBy(F.col("cost_usd").desc_nulls_last(), F.col("total_tokens").desc(), "name").limit(count)


def wrapped_months(usage: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """The year's twelve months with tokens and an intensity of 0 to 4 against the largest."""
    spark = usage.sparkSession
    sums = usage.where(in_local_window(F.col("ts"), f"{year}-01-01", f"{year}-12-31", tz)).withColumn("month", period_key(F.col("ts"), "month", tz)).groupBy("month").agg(F.sum("total_tokens").alias("t"))
    months = spark.range(1, 13).select(F.concat(F.lit(f"{year}-"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("month"))
    out = months.join(sums, "month", "left").select("month", F.coalesce("t", F.lit(0)).cast("bigint").alias("total_tokens"))
    most = F.max("total_tokens").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("level", F.when(F.col("total_tokens") <= 0, 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(4 * F.col("total_tokens") / most)))).cast("bigint"))


def cube(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """Cells by hour, source, model, project and machine, with cost by mode."""
    cost = lambda mode: money_sum(F.when(F.col("cost_mode") == mode, F.col("cost_usd"))).alias(f"{mode}_usd")
    rows = usage.select("*", period_key(F.col("ts"), "hour", tz).alias("hour"), F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)).alias("project"))
    rows = rows.withColumns({"model": F.coalesce("model", F.lit("(unknown)")), "machine": F.coalesce("machine", F.lit(LOCAL))})
    return rows.groupBy("hour", "source", "model", "project", "machine").agg(F.count("*").alias("events"), *totals(), cost("explicit"), cost("estimated"))


def cube_rollup(cells: DataFrame, keys: dict[str, object] | list[str]) -> DataFrame:
    """Cells summed by columns, or by named expressions of them."""
    named = [F.col(k) for k in keys] if isinstance(keys, list) else [v.alias(k) for k, v in keys.items()]
    return cells.groupBy(*named).agg(F.sum("events").alias("events"), F.sum("total_tokens").alias("total_tokens"), money_sum(F.col("cost_usd")).alias("cost_usd"))


def stack_top(cells: DataFrame, dimension: str, count: int) -> DataFrame:
    """(day, label, total_tokens): the `count` largest labels of a dimension, the rest as Other."""
    sums = cells.groupBy(dimension).agg(F.sum("total_tokens").alias("t"))
    ranked = sums.withColumn("r", F.row_number().over(Window.orderBy(F.col("t").desc(), dimension)))
    label = F.when(F.col("r") <= count, F.col(dimension)).otherwise("Other").alias("label")
    return cells.join(ranked.select(dimension, "r"), dimension).groupBy(F.substring("hour", 1, 10).alias("day"), label).agg(F.sum("total_tokens").alias("total_tokens"))


def hour_weekday(cells: DataFrame) -> DataFrame:
    """(weekday, hour, total_tokens, events), Monday first as 1."""
    day = F.substring("hour", 1, 10).cast("date")
    return cells.groupBy((F.weekday(day) + 1).cast("bigint").alias("weekday"), F.substring("hour", 12, 2).cast("bigint").alias("hour")).agg(F.sum("total_tokens").alias("total_tokens"), F.sum("events").alias("events"))


def agent_time(usage: DataFrame, unit: str = "day", tz: str = "UTC", labels: list[str] | None = None) -> DataFrame:
    """(period, labels, agent_ms): active gaps of sessions by local period and the columns in `labels`, source by default.

    A gap goes to the later event's labels; the part of it before that event's period goes to the
    earlier event's. Every period and labels with an event have a row.
    """
    labels = labels or ["source"]
    order = Window.partitionBy("source", "session_id").orderBy("end_ms", "event_index")
    rows = usage.select("source", "session_id", "event_index", F.struct(*labels).alias("_l"), epoch_ms(F.col("ts")).alias("end_ms"), period_key(F.col("ts"), unit, tz).alias("period"))
    rows = rows.withColumns({"start_ms": F.lag("end_ms").over(order), "_before": F.lag("_l").over(order), "_was": F.lag("period").over(order)})
    gaps = rows.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= IDLE_MS))
    whole = gaps.where(F.col("period") == F.col("_was")).select("period", "_l", (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    parts = split_steps(gaps.where(F.col("period") != F.col("_was"))).withColumn("_at", step_key(unit, tz))
    later = F.col("_at") == F.col("period")
    cut = parts.select(F.when(later, F.col("period")).otherwise(F.col("_was")).alias("period"), F.when(later, F.col("_l")).otherwise(F.col("_before")).alias("_l"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    every = rows.select("period", "_l", F.lit(0).cast("bigint").alias("ms")).unionByName(whole).unionByName(cut)
    return every.groupBy("period", *[F.col(f"_l.{c}").alias(c) for c in labels]).agg(F.sum("ms").alias("agent_ms"))


def providers(usage: DataFrame) -> DataFrame:
    return usage.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(provider_of_model(F.col("model")))), ",").alias("providers"))


def unpriced(usage: DataFrame) -> DataFrame:
    """Rows without cost and their models, by source."""
    none = F.col("cost_usd").isNull()
    return usage.groupBy("source").agg(F.count_if(none).alias("unpriced"), F.array_join(F.array_sort(F.collect_set(F.when(none, F.col("model")))), ",").alias("models"))


def busiest_day(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    return daily(usage, tz).orderBy(F.col("total_tokens").desc(), "day").limit(1).select("day", "total_tokens")


def spike_drivers(usage: DataFrame, days: DataFrame, column: str, tz: str = "UTC") -> DataFrame:
    """Of each day in days(day), the value that cost most; the smaller one on a tie."""
    sums = usage.where(F.col(column).isNotNull()).groupBy(period_key(F.col("ts"), "day", tz).alias("day"), column).agg(money_sum(F.col("cost_usd")).alias("c"))
    return sums.join(days.select("day"), "day").groupBy("day").agg(F.min(F.struct((-F.coalesce("c", F.lit(0.0))).alias("c"), F.col(column).alias("name")))["name"].alias("driver"))


def single_event_sources(usage: DataFrame) -> DataFrame:
    """Sources whose sessions have one event each."""
    n = usage.groupBy("source", "session_id").count()
    return n.groupBy("source").agg(F.bool_and(F.col("count") == 1).alias("single")).where("single").select("source")


def doctor(usage: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Health by source: files, events, first and last time, and skipped rows."""
    out = usage.groupBy("source").agg(F.count_distinct("file").alias("files"), F.count("*").alias("events"), F.min(epoch_ms(F.col("ts"))).alias("first_ms"), F.max(epoch_ms(F.col("ts"))).alias("last_ms"))
    if rejects is None:
        return out
    return out.join(rejects.groupBy("source").agg(F.count("*").alias("skipped")), "source", "full")


def session_details(rows: DataFrame, usage: DataFrame, calls: DataFrame, counted: list[str]) -> DataFrame:
    """rows(source, session_id, ...) with their files and, for sources in counted, numbers of tool calls and errors.

    Files of a session are few and are listed; calls are counted once each before they are joined.
    """
    files = usage.groupBy("source", "session_id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    n = calls.groupBy("source", "session_id").agg(F.count("*").alias("_calls"), F.count_if(F.col("status") == "error").alias("_errors"))
    out = rows.join(files, ["source", "session_id"], "left").join(n, ["source", "session_id"], "left")
    told = F.col("source").isin(counted)
    return out.withColumns({"tool_calls": F.when(told, F.coalesce("_calls", F.lit(0))), "tool_errors": F.when(told, F.coalesce("_errors", F.lit(0)))}).drop("_calls", "_errors")


def live_session_events(stored: DataFrame, read: DataFrame, remote: DataFrame | None = None, kinds: list[str] | None = None, since: str | None = None, until: str | None = None, tz: str = "UTC", sessions: DataFrame | None = None) -> DataFrame:
    """Session events of this machine, stored ones and those read from files that aren't stored, and other machines' that it doesn't have.

    All have (source, session_id, kind, ts, event_index, machine, file, body). Then the window,
    the kinds and, where given, sessions(source, session_id) narrow them.
    """
    from quillmeter.operators.joins import merge_session_events

    fresh = read.join(stored.select("source", "file").distinct(), ["source", "file"], "left_anti")
    here = stored.unionByName(fresh.select(*stored.columns))
    out = here if remote is None else merge_session_events(here, remote)
    out = out.where(in_local_window(F.col("ts"), since, until, tz))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    return out if sessions is None else out.join(sessions.select("source", "session_id").distinct(), ["source", "session_id"], "left_semi")


def statusline(usage: DataFrame, now: str, tz: str = "UTC") -> DataFrame:
    """One row: today's and the month's tokens and cost to date, the month's projected cost, and the current streak of days."""
    from quillmeter.operators.windows import month_end_projection, streaks

    at = F.lit(now).cast("timestamp_ntz")
    today = F.date_format(local(at, tz), "yyyy-MM-dd")
    day = period_key(F.col("ts"), "day", tz)
    rows = usage.where(F.col("ts") <= at)
    month = rows.where(F.substring(day, 1, 7) == F.substring(today, 1, 7))
    one = F.when(day == today, F.col("total_tokens"))
    sums = month.agg(F.coalesce(F.sum(one), F.lit(0)).alias("today_tokens"), money_sum(F.when(day == today, F.col("cost_usd"))).alias("today_usd"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("month_tokens"))
    ends = month_end_projection(usage, now, tz=tz).select(F.col("cost_usd").alias("month_usd"), "projected_usd")
    runs = streaks(rows.select(day.alias("day")))
    near = (F.col("last") >= F.date_format(F.date_sub(today.cast("date"), 1), "yyyy-MM-dd")) & (F.col("first") <= today)
    streak = runs.agg(F.coalesce(F.max(F.when(near, F.col("length"))), F.lit(0)).cast("bigint").alias("streak"))
    # three frames of one row each
    return sums.withColumn("_k", F.lit(0)).join(ends.withColumn("_k", F.lit(0)), "_k").join(streak.withColumn("_k", F.lit(0)), "_k").drop("_k")


def compare_projects(usage: DataFrame, now: tuple[str, str], before: tuple[str, str], count: int = 0, tz: str = "UTC") -> DataFrame:
    """Both windows by project, those whose cost changed most first; with count, the others folded into one row.

    Days of the folded projects count once, so the row is made from events again. Rows with an
    unknown cost are ranked by tokens.
    """
    rows = usage.withColumn("project", F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)))
    wide = compare(rows, now, before, ["project"], tz)
    change = F.abs(F.coalesce("cost_usd_now", F.lit(0.0)) - F.coalesce("cost_usd_before", F.lit(0.0)))
    order = F.row_number().over(Window.orderBy(F.round(change, 9).desc(), F.abs(F.col("total_tokens_now") - F.col("total_tokens_before")).desc(), "project"))
    ranked = wide.withColumn("rank", order.cast("bigint"))
    none = F.lit(None).cast("bigint").alias("other_projects")
    if not count:
        return ranked.select("*", none)
    rest = ranked.where(F.col("rank") > count).select("project")
    other = compare(rows.join(rest, "project", "left_semi").withColumn("project", F.lit(None).cast("string")), now, before, ["project"], tz)
    n = rest.agg(F.count("*").alias("other_projects")).withColumn("_k", F.lit(0))
    folded = other.withColumns({"rank": F.lit(count + 1).cast("bigint"), "_k": F.lit(0)}).join(n, "_k").drop("_k")
    return ranked.where(F.col("rank") <= count).select("*", none).unionByName(folded)


def by_peak(pressure: DataFrame) -> DataFrame:
    """Rows of context pressure, largest prompt first."""
    keys = [c for c in pressure.columns if c in ("model", "source", "session_id")]
    return pressure.orderBy(F.col("max_prompt").desc(), *keys)


def aggregated_requests(usage: DataFrame) -> DataFrame:
    """(source, rows): rows that stand for several requests or don't say, which context pressure can't judge."""
    return usage.where(~F.coalesce("single_request", F.lit(False))).groupBy("source").agg(F.count("*").alias("rows"))


def value_report(usage: DataFrame, plans: DataFrame, today: str, since: str | None = None, until: str | None = None, tz: str = "UTC") -> DataFrame:
    """value_months within a window that never passes today, with `partial`: months that the window cuts or that hold today."""
    from quillmeter.functions.ranges import value_window

    bounded = usage.where(in_local_window(F.col("ts"), since, min(until or today, today), tz))
    used = bounded.join(plans.select(F.explode("sources").alias("source")).distinct(), "source", "left_semi")
    first = used.agg(F.date_format(F.min(local(F.col("ts"), tz)), "yyyy-MM").alias("m")).first()["m"]
    start, end = value_window(today, since, until, first)
    if start is None:
        return value_months(bounded.limit(0), plans, tz).withColumn("partial", F.lit(False))
    found = value_months(bounded, plans, tz, start, end)
    begins, ends = F.concat("month", F.lit("-01")), F.date_format(F.last_day(F.concat("month", F.lit("-01")).cast("date")), "yyyy-MM-dd")
    return found.withColumn("partial", (F.lit(start) > begins) | (F.lit(end) < ends) | ((F.lit(today) >= begins) & (F.lit(today) <= ends)))


def selected_plans(known: DataFrame, names: list[str] | None = None, price: float | None = None, sources: list[str] | None = None) -> DataFrame:
    """Plans named, or the first of known(plan, sources, monthly_usd, nth) with a source that is kept; price replaces that of a single one."""
    if names:
        rows = known.where(F.col("plan").isin([n.strip() for n in names]))
    else:
        fits = known if not sources else known.where(F.arrays_overlap("sources", F.array(*[F.lit(x) for x in sources])))
        rows = fits.orderBy("nth").limit(1)
    own = rows.withColumn("price_source", F.lit("list"))
    if price is None:
        return own
    if rows.limit(2).count() != 1:
        raise ValueError("a price belongs to one plan")
    return own.withColumns({"monthly_usd": F.lit(float(price)), "price_source": F.lit("override")})


def efficiency_total(periods: DataFrame) -> DataFrame:
    """The sums of efficiency's periods with the same ratios, and each period's share of the cost."""
    whole = periods.agg(F.sum("total_tokens").alias("total_tokens"), money_sum(F.col("cost_usd")).alias("cost_usd"), F.sum("commits").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    lines = F.col("added") + F.col("deleted")
    return whole.withColumns({"usd_per_commit": ratio(F.col("cost_usd"), F.col("commits")), "usd_per_1k_lines": ratio(F.col("cost_usd") * 1000, lines), "tokens_per_commit": ratio(F.col("total_tokens"), F.col("commits")), "commits_per_usd": ratio(F.col("commits"), F.col("cost_usd"))})


def summary(usage: DataFrame, now: str, tz: str = "UTC") -> DataFrame:
    """(window, period, source, figures): today, the last 7 days and the month to date beside the windows before them, by source and in all.

    One pass: a row counts in every window that its local day lies in.
    """
    from quillmeter.functions.ranges import compare_windows, shift

    today = usage.sparkSession.range(1).select(F.date_format(local(F.lit(now).cast("timestamp_ntz"), tz), "yyyy-MM-dd").alias("d")).first()["d"]
    month, last_month = compare_windows(today)
    spans = [("today", "now", today, today), ("today", "before", shift(today, -1), shift(today, -1)), ("7 days", "now", shift(today, -6), today), ("7 days", "before", shift(today, -13), shift(today, -7)), ("month", "now", *month), ("month", "before", *last_month)]
    rows = usage.where(in_local_window(F.col("ts"), min(s[2] for s in spans), today, tz)).withColumn("_day", period_key(F.col("ts"), "day", tz))
    hits = F.filter(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(p).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for w, p, a, b in spans]), lambda s: F.col("_day").between(s["a"], s["b"]))
    wide = rows.withColumn("_s", F.explode(hits)).withColumns({"window": F.col("_s.window"), "period": F.col("_s.period")})
    keys = [F.col("window"), F.col("period"), F.col("source")]
    return wide.groupingSets([keys, keys[:2]], *keys).agg(F.count("*").alias("events"), F.count_distinct("_day").alias("active_days"), *totals())


def wrapped_figures(usage: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """One row of a year: totals, sessions, active days and time, the longest streak, the peak hour, weekdays against weekends, the busiest day."""
    from quillmeter.operators.windows import streaks, union_active_time

    rows = usage.where(in_local_window(F.col("ts"), f"{year}-01-01", f"{year}-12-31", tz))
    day, hour = period_key(F.col("ts"), "day", tz), F.hour(local(F.col("ts"), tz)).cast("bigint")
    rows = rows.withColumns({"_day": day, "_hour": hour, "_end": F.weekday(local(F.col("ts"), tz).cast("date")) >= 5})
    only = lambda test: F.coalesce(F.sum(F.when(test, F.col("total_tokens"))), F.lit(0))
    whole = rows.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), money_sum(F.col("cost_usd")).alias("cost_usd"), F.count("*").alias("events"), F.count_distinct("source", "session_id").alias("sessions"), F.count_distinct("_day").alias("active_days"), only(~F.col("_end")).alias("weekday_tokens"), only(F.col("_end")).alias("weekend_tokens"))
    best = lambda key: F.min(F.struct((-F.col("t")).alias("t"), F.col(key).alias("k")))["k"]
    hours = rows.groupBy("_hour").agg(F.sum("total_tokens").alias("t")).where("t > 0").agg(best("_hour").alias("peak_hour"))
    days = rows.groupBy("_day").agg(F.sum("total_tokens").alias("t")).agg(best("_day").alias("busiest_day"))
    streak = streaks(rows.select(F.col("_day").alias("day"))).agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_streak"))
    active = union_active_time(rows, ["source", "session_id"], tz).agg(F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"))
    out = whole.withColumn("_k", F.lit(0))
    for one in (hours, days, streak, active):
        out = out.join(one.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def machine_split(usage: DataFrame) -> DataFrame:
    """Totals by machine, this one named local."""
    return usage.groupBy(F.coalesce("machine", F.lit(LOCAL)).alias("machine")).agg(F.count("*").alias("events"), *totals())


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of sources, history and machines; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
