"""The queries of the reports and operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import calendar, text
from quillmeter.operators import dedupe, filters, joins, reports, totals, windows
from quillmeter.plans import bindings as b
from quillmeter.pricing import cost, rates, resolve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in TOKENS)
#: Through text, so that neither engine rounds on the way.
MONEY = "sum(cost_usd::varchar::decimal(38,12))::varchar::double"
T = f"{SUMS}, {MONEY} as cost_usd, coalesce(bool_or(cost_usd is null), false) as cost_incomplete"
U = "with " + b.USAGE_SQL
LINES = "with " + b.LINES_SQL
DAY = "strftime(ts, '%Y-%m-%d')"
PARIS = "timezone('Europe/Paris', timezone('UTC', ts))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# usage reports


def report_sql(period: str, keys: str = "", start: str = U) -> str:
    more = f", {keys}" if keys else ""
    level = f"grouping(period, source{more})"
    whole = 2 ** (2 + keys.count(",") + bool(keys)) - 1
    zero = ", ".join(f"case when l = {whole} then coalesce({c}, 0) else {c} end as {c}" for c in TOKENS)
    return f"""{start}, p as (select * replace (coalesce(machine, 'local') as machine), {period} as period from usage), g as (
  select period, source{more}, {level} as l, {T} from p group by grouping sets ((period, source{more}), (period), ())
), h as (select *, sum((l = 0)::int) over (partition by period) as groups from g)
select case l when 0 then 'period_source' when {whole} then 'grand_total' else 'period_combined' end as row_type, period, source{more}, {zero},
  case when l = {whole} and cost_usd is null and not cost_incomplete then 0 else cost_usd end as cost_usd, cost_incomplete
from h where l in (0, {whole}) or groups > 1"""


WEEK = "isoyear(ts)::varchar || '-W' || lpad(week(ts)::varchar, 2, '0')"


@query(report_sql(DAY))
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "day")


@query(report_sql(f"strftime({PARIS}, '%Y-%m-%d %H:00')"))
def usage_hourly(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "hour", "Europe/Paris")


@query(report_sql(WEEK))
def usage_weekly_iso(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "week")


@query(report_sql("strftime(ts, '%Y-%m')"))
def usage_monthly(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "month")


@query(report_sql(DAY, "machine"))
def usage_by_machine(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "day", by_machine=True)


@query(report_sql(DAY, "project"))
def usage_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return totals.usage_report(b.usage(spark, d), "day", by_repo=True)


@query(f"{LINES} select strftime(ts, '%Y-%m') as period, source, project, model, {T} from usage group by all")
def usage_at_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = b.line_usage(spark, d).withColumn("period", calendar.period_key(F.col("ts"), "month")).withColumn("project", text.project_key(F.col("repo_root")))
    return rows.groupBy("period", "source", "project", "model").agg(*totals.totals())


RANK = "row_number() over (partition by {keys} order by total_tokens desc, cost_usd desc nulls last, input_tokens desc, model)"


@query(f"{U}, g as (select {DAY} as day, source, model, {T} from usage where model is not null group by all) select *, {RANK.format(keys='day, source')} as rank from g")
def usage_model_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return totals.model_breakdown(b.usage(spark, d).withColumn("day", calendar.period_key(F.col("ts"), "day")), ["day", "source"])


@query(f"""{U}, g as (select {WEEK} as period, project, {T} from usage group by all), r as (
  select *, count(*) over w as n, bool_or(cost_incomplete) over w as t from g window w as (partition by period)
), k as (select *, row_number() over (partition by period order by case when t then total_tokens::double else coalesce(cost_usd, 0) end desc, total_tokens desc, project) as rk from r
), f as (select * replace (case when n > 4 and rk > 3 then null else project end as project) from k)
select period, project, {SUMS}, {MONEY} as cost_usd, bool_or(cost_incomplete) as cost_incomplete, case when project is null then count(*) end as other_projects from f group by period, project""")
def usage_fold_other(spark: SparkSession, d: str) -> DataFrame:
    return totals.fold_other_projects(b.usage(spark, d), "week", 3)


@query(f"""{U}, g as (select source, model, {T} from usage group by all)
select source, model, case when cost_usd is null then case when cost_incomplete then 'unknown' else 'none' end when cost_incomplete then 'partial' else 'known' end as state from g""")
def usage_cost_state(spark: SparkSession, d: str) -> DataFrame:
    return b.usage(spark, d).groupBy("source", "model").agg(*totals.totals()).select("source", "model", totals.cost_state().alias("state"))


# filters


def filter_sql(test: str) -> str:
    return f"{U} select source, count(*) as events, {SUMS} from usage where {test} group by source"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("events"), *[F.sum(c).alias(c) for c in TOKENS])


@query(filter_sql(f"strftime({PARIS}, '%Y-%m-%d') between '2024-01-05' and '2024-01-11'"))
def filter_local_window_tz(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.local_window(b.usage(spark, d), "2024-01-05", "2024-01-11", "Europe/Paris"))


@query(filter_sql("ts >= '2024-01-03 12:00:00' and ts < '2024-01-09'"))
def filter_instant_window(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.instant_window(b.usage(spark, d), "2024-01-03 12:00:00", "2024-01-09 00:00:00"))


@query(filter_sql("contains(case lower(trim(provider)) when 'openai-codex' then 'openai' else lower(trim(provider)) end, 'open')"))
def filter_provider_substring(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.provider(b.usage(spark, d), "Open"))


@query(filter_sql("model = 'gpt-5-codex' or contains(model, 'opus')"))
def filter_model_exact_or_substring(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.model(b.usage(spark, d), ["GPT-5-codex", "opus"]))


@query(filter_sql("project = '/home/dev/alpha' or project like '/home/dev/alpha/%'"))
def filter_repo_path(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.repo(b.usage(spark, d), "/home/dev/alpha/"))


@query(filter_sql("project = 'packages/core' or project like '%/packages/core'"))
def filter_repo_suffix(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.repo(b.usage(spark, d), "packages/core"))


@query(filter_sql("contains(lower(session_id), 'u1')"))
def filter_session_id(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.session(b.usage(spark, d), ["U1"]))


@query(filter_sql("coalesce(machine, 'local') in ('local', 'box2')"))
def filter_machine(spark: SparkSession, d: str) -> DataFrame:
    return counted(filters.machine(b.usage(spark, d), ["local", "box2"]))


@query("with v(w) as (values ('click'), ('nothing')) select w as value from v where not exists (select 1 from events where contains(lower(event_type), w))")
def filter_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return filters.unmatched_values(b.usage(spark, d), "source", ["click", "nothing"])


# pricing: the rates as SQL, with the keys that the names of B1 resolve to

RATES_SQL = """r(model, i, o, cr, cw, c1, rs, apart, lim, t_above, ti, t_o, tcr, tcw, tc1) as (values
  ('claude-sonnet-4-5', 3.0::double, 15.0::double, 0.3::double, 3.75::double, 6.0::double, null::double, false, 200000, 200000, 6.0::double, 22.5::double, 0.6::double, 7.5::double, 12.0::double),
  ('claude-opus-4-1-20250805', 15.0, 75.0, 1.5, 18.75, 30.0, null, false, 200000, null, null, null, null, null, null),
  ('gpt-5-codex', 1.25, 10.0, 0.125, null, null, null, false, 400000, null, null, null, null, null, null),
  ('gemini-2.5-pro', 1.25, 10.0, 0.31, 1.25, null, 10.0, true, 1048576, 2000, 1.5, 11.0, 0.4, 1.5, null)
), q as (
  select usage.*, r.* exclude (model), case when apart then greatest(0, output_tokens - reasoning_tokens) else output_tokens end as bo, case when apart then reasoning_tokens else 0 end as br,
    input_tokens + cache_read_tokens + cache_write_tokens as prompt from usage left join r using (model)
), q2 as (select *, coalesce(single_request and prompt > t_above, false) as tier from q), q3 as (
  select *, case when tier then coalesce(ti, i) else i end as xi, case when tier then coalesce(t_o, o) else o end as xo, case when tier then coalesce(tcr, cr) else cr end as xcr,
    case when tier then coalesce(tcw, cw) else cw end as xcw, case when tier then coalesce(tc1, c1) else c1 end as xc1 from q2
), est as (
  select *, case when i is not null and not (cache_write_tokens > 0 and xcw is null) and not (reasoning_tokens > 0 and not apart and output_tokens = 0)
      and (input_tokens > 0 or output_tokens > 0 or cache_read_tokens > 0 or cache_write_tokens > 0 or (reasoning_tokens > 0 and apart)) then
    0.0::double + input_tokens / 1e6::double * xi + bo / 1e6::double * xo + cache_read_tokens / 1e6::double * xcr + coalesce((cache_write_tokens - cache_write_1h_tokens) / 1e6::double * xcw, 0)
      + coalesce(cache_write_1h_tokens / 1e6::double * coalesce(xc1, xcw), 0) + coalesce(br / 1e6::double * rs, 0) end as estimate,
    case when i is not null and not (cache_write_tokens > 0 and cw is null) then
    0.0::double + input_tokens / 1e6::double * i + bo / 1e6::double * o + cache_read_tokens / 1e6::double * cr + coalesce((cache_write_tokens - cache_write_1h_tokens) / 1e6::double * cw, 0)
      + coalesce(cache_write_1h_tokens / 1e6::double * coalesce(c1, cw), 0) + coalesce(br / 1e6::double * rs, 0) end as base_estimate from q3
)"""
PRICE = "source, coalesce(model, '-') as model, count(*) as events, count({c}) as with_cost, round(sum({c}::decimal(38,12)), 8)::double as usd"


def price_sql(expression: str) -> str:
    return f"{U}, {RATES_SQL}, x as (select *, {expression} as c from est) select {PRICE.format(c='c')} from x group by all"


def price_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("source", F.coalesce("model", F.lit("-")).alias("model")).agg(F.count("*").alias("events"), F.count("cost_usd").alias("with_cost"), F.round(F.sum(F.col("cost_usd").cast("decimal(38,12)")), 8).cast("double").alias("usd"))


@query(price_sql("case when cost_usd is null or cost_usd = 0 then coalesce(estimate, cost_usd) else cost_usd end"))
def price_both(spark: SparkSession, d: str) -> DataFrame:
    return price_rows(cost.priced(b.usage(spark, d), rates.example_rates(spark), "both"))


@query(price_sql("cost_usd"))
def price_explicit(spark: SparkSession, d: str) -> DataFrame:
    return price_rows(cost.priced(b.usage(spark, d), rates.example_rates(spark), "explicit"))


@query(price_sql("estimate"))
def price_estimated(spark: SparkSession, d: str) -> DataFrame:
    return price_rows(cost.priced(b.usage(spark, d), rates.example_rates(spark), "estimated"))


@query(f"{U}, {RATES_SQL} select source, coalesce(model, '-') as model, count(*) as requests, count(*) filter (tier) as in_tier, round(sum((case when tier then estimate - base_estimate when i is not null then 0 end)::decimal(38,12)), 8)::double as extra_usd from est where single_request group by all")
def price_tiered(spark: SparkSession, d: str) -> DataFrame:
    rated = cost.long_context_extra(cost.with_rates(b.usage(spark, d).where("single_request"), rates.example_rates(spark)))
    in_tier = F.exists("rates.tiers", lambda t: cost.prompt_tokens() > t["above"])
    return rated.groupBy("source", F.coalesce("model", F.lit("-")).alias("model")).agg(F.count("*").alias("requests"), F.count_if(F.coalesce(in_tier, F.lit(False))).alias("in_tier"), F.round(F.sum(F.col("tier_extra").cast("decimal(38,12)")), 8).cast("double").alias("extra_usd"))


NAMES = {
    "claude-sonnet-4-5": ("claude-sonnet-4-5", "direct"),
    "anthropic/claude-opus-4-1": ("claude-opus-4-1", "direct"),
    "gpt-5-codex-high": ("gpt-5-codex", "effort_suffix"),
    "kimi-k2": ("moonshot/kimi-k2", "provider_prefixed"),
    "claude-opus-4-1-20250805": ("claude-opus-4-1", "release_suffix"),
    "claude-sonnet-4-5-thinking": ("claude-sonnet-4-5", "release_suffix"),
    "claude-sonnet-4-5@20250929": ("claude-sonnet-4-5", "release_suffix"),
    "claude-opus-4-1-20250805-v1:0": ("claude-opus-4-1", "release_suffix"),
    "us/claude-opus-4-1-2025-08-05-high": ("claude-opus-4-1", "release_suffix"),
    "gpt-5-codex-latest": ("gpt-5-codex", "release_suffix"),
    "gpt-5-codex-v2": (None, None),
    "gemini-2.5-pro-preview-05-06": (None, None),
    "moonshot/kimi-k2-thinking": (None, None),
    "gpt-5-codex-mini": (None, None),
    "gemni-2.5-flash": ("gemini-2.5-flash", "fuzzy"),
    "gpt5-minii": ("gpt-5-mini", "fuzzy"),
    "unknown-model": (None, None),
    "fast": ("gpt-5-mini", "alias"),
}


def names_sql(rules: bool) -> str:
    rows = [f"('{m}', {'null' if k is None else repr(k)}, {'null' if r is None else repr(r)})" for m, (k, r) in NAMES.items() if (r == "fuzzy") != rules]
    return "select * from (values " + ", ".join(rows) + ") as t(model, model_key, rule)"


def resolved(spark: SparkSession, rules: bool) -> DataFrame:
    names = spark.createDataFrame([(m,) for m, (_, r) in NAMES.items() if (r == "fuzzy") != rules], "model string")
    return resolve.resolve_models(names, rates.example_rates(spark), spark.createDataFrame([("fast", "gpt-5-mini")], "alias string, model_key string"))


@query(names_sql(True))
def resolve_model_rules(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, True)


@query(names_sql(False))
def resolve_model_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, False)


@query(f"{U}, {RATES_SQL} select round(sum(case when cache_read_tokens > 0 and cr is not null then greatest(0, cache_read_tokens / 1e6::double * (i - cr)) end::decimal(38,12)), 9)::double as saved_usd, count(*) filter (cache_read_tokens > 0 and cr is not null) as rows from est")
def cache_savings(spark: SparkSession, d: str) -> DataFrame:
    return reports.cache_savings(b.usage(spark, d), rates.example_rates(spark))


def context_sql(keys: str) -> str:
    return f"{U}, {RATES_SQL} select {keys}, count(*) as requests, max(prompt) as max_prompt, count(*) filter (prompt > 200000) as over_200k, count(*) filter (prompt > lim * 0.8) as near_limit, round(sum((case when tier then estimate - base_estimate when i is not null then 0 end)::decimal(38,12)), 9)::double as tier_extra_usd from est where single_request group by all"


@query(context_sql("model"))
def context_pressure_model(spark: SparkSession, d: str) -> DataFrame:
    return reports.context_pressure(b.usage(spark, d), rates.example_rates(spark), ["model"])


@query(context_sql("source, session_id"))
def context_pressure_session(spark: SparkSession, d: str) -> DataFrame:
    return reports.context_pressure(b.usage(spark, d), rates.example_rates(spark), ["source", "session_id"])


# sessions, projects, tools

GAPS = "gaps as (select source, session_id, ms, ts, ms - lag(ms) over (partition by source, session_id order by ms) as gap from usage)"
ACTIVE = "active as (select source, session_id, coalesce(sum(gap) filter (gap <= 300000), 0)::bigint as active_ms from gaps group by all)"
SESSIONS = f"""{GAPS}, {ACTIVE}, sess as (select source, session_id, min(ms) as first_ms, max(ms) as last_ms, count(*) as events, coalesce(string_agg(distinct model, ',' order by model), '') as models,
  sum(case when cost_mode = 'explicit' then cost_usd end::varchar::decimal(38,12))::varchar::double as explicit_usd, sum(case when cost_mode = 'estimated' then cost_usd end::varchar::decimal(38,12))::varchar::double as estimated_usd, {T}
  from usage group by source, session_id), rows_ as (select *, last_ms - first_ms as duration_ms from sess join active using (source, session_id))"""


@query(f"{U}, {SESSIONS} select * from rows_")
def session_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.sessions(b.usage(spark, d))


@query(f"{U}, {SESSIONS} select source, session_id, cost_usd, total_tokens, events from rows_ order by cost_usd desc nulls last, last_ms desc, session_id, source limit 20")
def session_top20(spark: SparkSession, d: str) -> DataFrame:
    return totals.top(reports.sessions(b.usage(spark, d)), 20, *reports.session_order()).select("source", "session_id", "cost_usd", "total_tokens", "events")


@query(f"{U} select project, count(distinct source || ':' || session_id) as sessions, string_agg(distinct source, ',' order by source) as sources, count(*) as events, {T} from usage group by project")
def session_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return reports.sessions_by_repo(b.usage(spark, d))


RUNNING = "(sum(cost_usd::varchar::decimal(38,12)) over w)::varchar::double as running_usd, bool_or(cost_usd is null) over w as running_incomplete"


@query(f"{U} select source, session_id, event_index, {RUNNING} from usage where session_id = 'u8' window w as (partition by source, session_id order by ts, event_index rows unbounded preceding)")
def session_timeline(spark: SparkSession, d: str) -> DataFrame:
    one = b.usage(spark, d).where("session_id = 'u8'")
    return windows.running_cost(one, ["source", "session_id"], ["ts", "event_index"]).select("source", "session_id", "event_index", "running_usd", "running_incomplete")


@query(f"{U} select machine, event_index, {RUNNING} from usage window w as (partition by machine, source, session_id order by ts, event_index rows unbounded preceding)")
def running_cost(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_cost(b.usage(spark, d), ["machine", "source", "session_id"], ["ts", "event_index"]).select("machine", "event_index", "running_usd", "running_incomplete")


@query(f"""{U}, g as (select project, count(*) as events, count(distinct {DAY}) as active_days, {T} from usage group by project),
m as (select project, model, sum(total_tokens) as t, {MONEY} as c, sum(input_tokens) as i from usage where model is not null group by all),
k as (select *, row_number() over (partition by project order by t desc, c desc nulls last, i desc, model) as r from m),
top as (select project, string_agg(model, ',' order by r) as top_models from k where r <= 3 group by project)
select g.*, round(cost_usd / (select {MONEY} from usage), 6) as cost_share, top_models from g left join top using (project)""")
def projects(spark: SparkSession, d: str) -> DataFrame:
    return reports.projects(b.usage(spark, d))


def tools_sql(keys: str) -> str:
    return f"""with {b.CALLS_SQL}, n as (select lower(name) as key{keys}, name, count(*) as c from calls group by all),
dn as (select key{keys}, arg_min(name, (-c, name)) as display_name from n group by all)
select *, case when calls > unknown then errors / (calls - unknown) end as error_rate from (
select lower(name) as key{keys}, count(*) as calls, count(*) filter (status = 'error') as errors, count(*) filter (status = 'unknown') as unknown, count(distinct source || ':' || session_id) as sessions
from calls group by all) join dn using (key{keys})"""


@query(tools_sql(""))
def tools(spark: SparkSession, d: str) -> DataFrame:
    return reports.tools(b.tool_calls(spark, d))


@query(tools_sql(", source"))
def tools_by_source(spark: SparkSession, d: str) -> DataFrame:
    return reports.tools(b.tool_calls(spark, d), by_source=True)


@query(f"""with {b.CALLS_SQL}, o as (select *, row_number() over (partition by source, call_id order by ts, event_index) as r,
  first_value(case when status <> 'unknown' then status end ignore nulls) over (partition by source, call_id order by ts, event_index rows between unbounded preceding and unbounded following) as s from calls)
select source, session_id, call_id, name, coalesce(s, status) as status, event_index from o where r = 1""")
def dedupe_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.tool_calls(b.tool_calls(spark, d)).select("source", "session_id", "call_id", "name", "status", "event_index")


@query("select 'chat' as source, conv_id::varchar as session_id, role, count(*) as messages, sum(length(text))::bigint as text_length from conversations group by all")
def messages_by_session(spark: SparkSession, d: str) -> DataFrame:
    return b.messages(spark, d).groupBy("source", "session_id", "role").agg(F.count("*").alias("messages"), F.sum("text_length").alias("text_length"))


# comparison, value, optimization, efficiency, recap

NOW, BEFORE = ("2024-01-15", "2024-01-21"), ("2024-01-08", "2024-01-14")


def side(name: str, dates: tuple[str, str]) -> str:
    test = f"day between '{dates[0]}' and '{dates[1]}'"
    sums = ", ".join(f"coalesce(sum({c}) filter ({test}), 0)::bigint as {c}_{name}" for c in TOKENS)
    return f"{sums}, count(*) filter ({test}) as events_{name}, count(distinct day) filter ({test}) as active_days_{name}, case when count(*) filter ({test}) = 0 then 0 else (sum(cost_usd::varchar::decimal(38,12)) filter ({test}))::varchar::double end as cost_usd_{name}"


WIDE = f"{U}, d as (select *, {DAY} as day from usage), x as (select * from d where day between '{BEFORE[0]}' and '{NOW[1]}')"


@query(f"{WIDE}, w as (select {side('now', NOW)}, {side('before', BEFORE)} from x), l as (" + " union all ".join(f"select '{m}' as metric, {m}_now::double as now, {m}_before::double as before from w" for m in reports.METRICS) + ") select *, now - before as delta, round(case when before = 0 then case when now = 0 then 0 end else (now - before) / before end, 9) as ratio from l")
def compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    return reports.compare_metrics(b.usage(spark, d), NOW, BEFORE)


@query(f"{WIDE} select source, {side('now', NOW)}, {side('before', BEFORE)} from x group by source")
def compare_sources(spark: SparkSession, d: str) -> DataFrame:
    return reports.compare(b.usage(spark, d), NOW, BEFORE, ["source"])


PLANS = [("small", ["click", "view"], 20.0), ("large", ["error", "purchase", "signup"], 100.0)]


@query(f"{U}, plans(plan, source, monthly_usd) as (values " + ", ".join(f"('{p}', '{s}', {m}::double)" for p, ss, m in PLANS for s in ss) + f"""), months as (
  select strftime(unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), interval 1 month)), '%Y-%m') as month from usage
), used as (select strftime(ts, '%Y-%m') as month, plan, {MONEY} as usd, sum(total_tokens)::bigint as t from usage join plans using (source) group by all)
select month, plan, monthly_usd, coalesce(usd, 0) as usage_usd, coalesce(t, 0) as total_tokens, round(coalesce(usd, 0) / monthly_usd, 6) as value_ratio
from months cross join (select distinct plan, monthly_usd from plans) left join used using (month, plan)""")
def value_months(spark: SparkSession, d: str) -> DataFrame:
    return reports.value_months(b.usage(spark, d), spark.createDataFrame(PLANS, "plan string, sources array<string>, monthly_usd double"))


@query(f"""{U}, s as (select {DAY} as period, sum(input_tokens) as i, sum(output_tokens) as o, sum(reasoning_tokens) as r, sum(cache_read_tokens) as cr, sum(cache_write_tokens) as cw, sum(cache_write_1h_tokens) as c1, {MONEY} as baseline_usd from usage group by all),
x as (select period, baseline_usd, 'claude-sonnet-4-5' as candidate, round(i / 1e6::double * 3 + o / 1e6::double * 15 + cr / 1e6::double * 0.3::double + (cw - c1) / 1e6::double * 3.75::double + c1 / 1e6::double * 6, 9) as candidate_usd from s
union all select period, baseline_usd, 'gemini-2.5-flash', round(i / 1e6::double * 0.3::double + greatest(0, o - r) / 1e6::double * 2.5::double + cr / 1e6::double * 0.075::double + (cw - c1) / 1e6::double * 0.3::double + c1 / 1e6::double * 0.3::double + r / 1e6::double * 2.5::double, 9) from s
union all select period, baseline_usd, 'gpt-5-mini', round(i / 1e6::double * 0.25::double + o / 1e6::double * 2 + cr / 1e6::double * 0.025::double + (cw - c1) / 1e6::double * 0.25::double + c1 / 1e6::double * 0.25::double, 9) from s),
a as (select *, sum(candidate_usd::decimal(38,12)) over (partition by candidate) as w from x)
select period, candidate, baseline_usd, candidate_usd, round(baseline_usd - candidate_usd, 9) as savings_usd, round(candidate_usd / nullif(baseline_usd, 0), 6) as cost_ratio, dense_rank() over (order by w nulls last, candidate) as rank from a""")
def optimize_counterfactual(spark: SparkSession, d: str) -> DataFrame:
    return reports.counterfactual(b.usage(spark, d), rates.example_rates(spark), ["claude-sonnet-4-5", "gemini-2.5-flash", "gpt-5-mini"], "day")


@query(f"""{U}, {b.COMMITS_SQL}, u as (select {DAY} as period, sum(total_tokens)::bigint as total_tokens, {MONEY} as cost_usd from usage group by all),
c as (select {DAY} as period, count(*) as commits, sum(added)::bigint as added, sum(deleted)::bigint as deleted from commits group by all)
select *, round(cost_usd / commits, 6) as usd_per_commit, round(cost_usd * 1000 / nullif(added + deleted, 0), 6) as usd_per_1k_lines, round(total_tokens / commits, 6) as tokens_per_commit, round(commits / nullif(cost_usd, 0), 6) as commits_per_usd from u join c using (period)""")
def efficiency_period(spark: SparkSession, d: str) -> DataFrame:
    return reports.efficiency(b.usage(spark, d), b.commits(spark, d), "day")


@query(f"{U}, {b.COMMITS_SQL} select {DAY} as day, count(*) as commits from commits where {DAY} in (select {DAY} from usage) group by all")
def commits_on_usage_days(spark: SparkSession, d: str) -> DataFrame:
    day = calendar.period_key(F.col("ts"), "day")
    kept = joins.commit_days(b.commits(spark, d).withColumn("day", day), b.usage(spark, d).withColumn("day", day))
    return kept.groupBy("day").agg(F.count("*").alias("commits"))


@query(f"{U} select model as name, sum(total_tokens)::bigint as total_tokens, {MONEY} as cost_usd from usage where model is not null and year(ts) = 2024 group by model order by cost_usd desc nulls last, total_tokens desc, name limit 3")
def wrapped_top_models(spark: SparkSession, d: str) -> DataFrame:
    return reports.wrapped_top(b.usage(spark, d), 2024, "model", 3)


@query(f"""{U}, m as (select '2024-' || lpad(i::varchar, 2, '0') as month from range(1, 13) t(i)), s as (select strftime(ts, '%Y-%m') as month, sum(total_tokens)::bigint as t from usage group by all),
x as (select month, coalesce(t, 0) as total_tokens from m left join s using (month))
select month, total_tokens, (case when total_tokens <= 0 then 0 else least(4, greatest(1, ceil(4 * total_tokens / max(total_tokens) over ()))) end)::bigint as level from x""")
def wrapped_months(spark: SparkSession, d: str) -> DataFrame:
    return reports.wrapped_months(b.usage(spark, d), 2024)


@query(f"{U}, x as (select *, {DAY} as day from usage) select source, count(*) as events, count(distinct day) as active_days, {T} from x where day between '2024-01-01' and '2024-01-07' group by grouping sets ((source), ())")
def summary_windows(spark: SparkSession, d: str) -> DataFrame:
    return reports.window_summary(b.usage(spark, d), "2024-01-01", "2024-01-07")


@query(f"{U} select '2024-01' as month, {MONEY} as cost_usd, {MONEY} / ((epoch_ms(timestamp '2024-01-20 06:00:00') - epoch_ms(timestamp '2024-01-01')) / 86400000.0::double) * 31 as projected_usd from usage where ts <= '2024-01-20 06:00:00'")
def month_end(spark: SparkSession, d: str) -> DataFrame:
    return windows.month_end_projection(b.usage(spark, d), "2024-01-20 06:00:00")


@query(f"{U} select source, count(*) filter (cost_usd is null) as unpriced, coalesce(string_agg(distinct case when cost_usd is null then model end, ',' order by case when cost_usd is null then model end), '') as models from usage group by source")
def unpriced_note(spark: SparkSession, d: str) -> DataFrame:
    return reports.unpriced(b.usage(spark, d))


@query(f"{U} select source, count(distinct file) as files, count(*) as events, min(ms) as first_ms, max(ms) as last_ms from usage group by source")
def doctor(spark: SparkSession, d: str) -> DataFrame:
    return reports.doctor(b.usage(spark, d))


# windows


@query(f"{U}, {GAPS}, {ACTIVE} select * from active")
def active_time_session(spark: SparkSession, d: str) -> DataFrame:
    return windows.active_time(b.usage(spark, d), ["source", "session_id"])


@query(f"""{U}, g as (select ms, lag(ms) over (partition by machine order by ms) as p from usage), i as (select p as a, ms as b from g where ms > p and ms - p <= 300000),
c as (select unnest(generate_series(a // 86400000, b // 86400000)) as d, a, b from i), k as (select d, greatest(a, d * 86400000) as a, least(b, (d + 1) * 86400000) as b from c),
r as (select *, max(b) over (partition by d order by a, b rows between unbounded preceding and 1 preceding) as reach from k where b > a)
select strftime(make_timestamp_ms((d * 86400000)::bigint), '%Y-%m-%d') as day, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::bigint as active_ms from r group by d""")
def active_time_union_day(spark: SparkSession, d: str) -> DataFrame:
    return windows.union_active_time(b.usage(spark, d), ["machine"])


BLOCKS = f"""recursive {b.USAGE_SQL}, o as (select source, ms, row_number() over (partition by source order by ms) as n from usage), chain as (
  select source, n, ms, ms // 3600000 * 3600000 as s from o where n = 1
  union all select o.source, o.n, o.ms, case when o.ms >= c.s + 18000000 then o.ms // 3600000 * 3600000 else c.s end from chain c join o on o.source = c.source and o.n = c.n + 1
), starts as (select distinct source, s from chain), placed as (
  select u.*, st.s as block_start_ms from usage u asof join starts st on u.source = st.source and u.ms >= st.s
), bl as (select source, block_start_ms, block_start_ms + 18000000 as block_end_ms, min(ms) as first_ms, max(ms) as last_ms, count(*) as events, {T} from placed group by source, block_start_ms)"""


@query(f"with {BLOCKS} select * from bl")
def blocks_5h(spark: SparkSession, d: str) -> DataFrame:
    return windows.blocks(b.usage(spark, d))


@query(f"with {BLOCKS} select source, block_start_ms, total_tokens, events from bl order by (case when (select bool_or(cost_incomplete or cost_usd is null) from bl) then total_tokens::double else cost_usd end) desc, block_start_ms, source limit 20")
def blocks_top(spark: SparkSession, d: str) -> DataFrame:
    return windows.ranked_blocks(windows.blocks(b.usage(spark, d)), 20).select("source", "block_start_ms", "total_tokens", "events")


@query(f"with {BLOCKS} select source, event_index, block_start_ms from placed")
def event_to_block(spark: SparkSession, d: str) -> DataFrame:
    u = b.usage(spark, d)
    return joins.event_to_block(u.select("source", "ts", "event_index"), windows.block_starts(u).select("source", "block_start_ms")).select("source", "event_index", "block_start_ms")


STREAKS = f"""{U}, dd as (select distinct session_id, ts::date as d from usage), rr as (select session_id, d, d - row_number() over (partition by session_id order by d)::int as run from dd),
st as (select session_id, min(d) as a, max(d) as z, count(*) as n from rr group by session_id, run)"""


@query(f"{STREAKS} select session_id, max(n) as longest from st group by session_id")
def streak_longest(spark: SparkSession, d: str) -> DataFrame:
    return windows.longest_streak(b.usage(spark, d).withColumn("day", F.to_date("ts")), ["session_id"])


@query(f"{STREAKS} select session_id, max(case when a <= date '2024-01-20' and z >= date '2024-01-19' then least(z, date '2024-01-20') - a + 1 else 0 end)::bigint as current from st group by session_id")
def streak_current(spark: SparkSession, d: str) -> DataFrame:
    return windows.current_streak(b.usage(spark, d).withColumn("day", F.to_date("ts")), "2024-01-20", ["session_id"])


LINE_DAYS = f"{LINES}, dd as (select {DAY} as day, sum(total_tokens)::bigint as total_tokens, {MONEY} as cost_usd from usage group by all), cal as (select strftime(unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day)), '%Y-%m-%d') as day from dd), full_ as (select day, coalesce(total_tokens, 0) as total_tokens, coalesce(cost_usd, 0) as cost_usd, total_tokens is not null as observed from cal left join dd using (day))"


@query(f"{LINE_DAYS}, ww as (select day, cost_usd, list_sort(list_filter(list(cost_usd) over (order by day rows between 28 preceding and 1 preceding), lambda c: c > 0)) as v from full_), mm as (select *, case when len(v) % 2 = 1 then v[len(v) // 2 + 1] when len(v) > 0 then (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 end as median_usd from ww) select day, cost_usd, median_usd from mm where cost_usd >= 1 and len(v) >= 3 and cost_usd >= 3 * median_usd")
def spend_spikes(spark: SparkSession, d: str) -> DataFrame:
    return windows.spend_spikes(b.line_usage(spark, d))


@query(f"{LINE_DAYS}, v as (select list_sort(list(total_tokens)) as v from dd where total_tokens > 0), q as (select v[floor(0.25 * (len(v) - 1))::int + 1] as a, v[floor(0.5 * (len(v) - 1))::int + 1] as b, v[floor(0.75 * (len(v) - 1))::int + 1] as c from v) select day, total_tokens, (case when total_tokens <= 0 then 0 when total_tokens <= a then 1 when total_tokens <= b then 2 when total_tokens <= c then 3 else 4 end)::bigint as level from full_, q")
def activity_levels(spark: SparkSession, d: str) -> DataFrame:
    return windows.activity_levels(b.line_usage(spark, d))


@query(f"{LINE_DAYS} select day, total_tokens, cost_usd, false as cost_incomplete, observed from full_")
def trends_dense(spark: SparkSession, d: str) -> DataFrame:
    return windows.trends(b.line_usage(spark, d))


# a gap over midnight belongs to both days, to each with its own part
AGENT = f"""{GAPS}, cut as (select source, ms, gap, least(gap, ms % 86400000) as late from gaps where gap <= 300000), parts as (
  select {DAY} as day, source, 0 as ms from usage union all select strftime(make_timestamp_ms(ms), '%Y-%m-%d'), source, late from cut
  union all select strftime(make_timestamp_ms(ms - gap), '%Y-%m-%d'), source, gap - late from cut where gap > late)"""


@query(f"{U}, {AGENT} select day, source, sum(ms)::bigint as agent_ms from parts group by all")
def agent_time(spark: SparkSession, d: str) -> DataFrame:
    return reports.agent_time(b.usage(spark, d)).withColumnRenamed("period", "day")


# counting once, merging, attribution

HASHED = """hashed as (select *, substr(sha256(source || chr(31) || session_id || chr(31) || ms || chr(31) || coalesce(repo_root, '') || chr(31) || coalesce(provider, '') || chr(31) || coalesce(model, '') || chr(31)
  || input_tokens || chr(31) || output_tokens || chr(31) || reasoning_tokens || chr(31) || cache_read_tokens || chr(31) || cache_write_tokens || chr(31) || total_tokens || chr(31)
  || coalesce(cost_usd::varchar::decimal(38,12)::varchar, '') || chr(31) || cost_mode), 1, 16) as h from usage)"""


@query(f"{U}, {HASHED} select event_index, h as content_hash from hashed")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    u = b.usage(spark, d)
    return u.select("event_index", dedupe.content_hash(u).alias("content_hash"))


@query(f"""{LINES}, f as (select l_suppkey % 7 as file, l_quantity::bigint as q, l_linenumber as n, l_orderkey * 10 + l_linenumber as i from lineitem),
o as (select *, row_number() over (partition by file, q, n order by i) as nth from f), p as (select *, row_number() over (partition by q, n, nth order by file) as r from o) select file, q, n, i from p where r = 1""")
def dedupe_repeated_files(spark: SparkSession, d: str) -> DataFrame:
    li = b.table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("file"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return dedupe.repeated_across_files(li, F.struct("q", "n"), "file", "i")


COPIES = """copies as (
  select event_type as source, 'u' || user_id as session_id, ts, event_id as i, 'm' || event_id as mid from events
  union all select event_type, 'copy' || user_id % 5, ts, event_id + 10000000, 'm' || event_id from events where event_id % 4 = 0)"""


@query(f"""with {COPIES}, s as (select *, min(ts) over (partition by source, session_id) as st from copies),
r as (select *, row_number() over (partition by source, ts, mid order by st, session_id, i) as r from s) select source, session_id, i as event_index from r where r = 1""")
def dedupe_copied_sessions(spark: SparkSession, d: str) -> DataFrame:
    u = b.usage(spark, d).withColumn("message_id", F.concat(F.lit("m"), F.col("event_index").cast("string")))
    copy = u.where("event_index % 4 = 0").withColumns({"session_id": F.concat(F.lit("copy"), (F.substring("session_id", 2, 20).cast("bigint") % 5).cast("string")), "event_index": F.col("event_index") + 10000000})
    return dedupe.copied_sessions(u.unionByName(copy)).select("source", "session_id", "event_index")


MERGED = """far0 as (
  select event_index, machine, h, case when event_index % 4 = 0 then null else 'm' || event_index % 1000 end as mid, case when event_index % 6 < 3 then null else 'r' || event_index % 7 end as rid from hashed where machine is not null
), far as (select *, case when mid is null and rid is null then '' else coalesce(mid, '') || '|' || coalesce(rid, '') end as id from far0
), near as (select event_index, h, case when event_index % 15 < 5 then '' when event_index % 15 < 10 then id else 'other|' end as id from far where event_index % 5 = 0
), n as (select h, count(*) filter (id <> '') as w, count(*) filter (id = '') as b from near group by h), o as (select h, id, count(*) as a from near where id <> '' group by all
), p as (
  select f.*, coalesce(o.a, 0) as a, coalesce(n.w, 0) as w, coalesce(n.b, 0) as b, row_number() over (partition by f.machine, f.h, f.id order by event_index) as k from far f left join n using (h) left join o on o.h = f.h and o.id = f.id
), q as (select *, id <> '' and k <= a as own from p
), r as (select *, sum(own::int) over (partition by machine, h) as used, row_number() over (partition by machine, h, id = '', own order by event_index) as k2 from q
), s as (select *, id = '' and k2 <= w - used as h2, id <> '' and not own and k2 <= b as h3 from r
), v as (select *, sum(h3::int) over (partition by machine, h) as used3, row_number() over (partition by machine, h, id = '', h2 order by event_index) as k4 from s
), t as (select *, own or h2 or h3 or (id = '' and not h2 and k4 <= b - used3) as hit from v)"""


@query(f"{U}, {HASHED}, {MERGED} select coalesce(machine, 'local') as machine, count(*) as events, sum(event_index)::bigint as places from (select machine, event_index from t where not hit union all select null, event_index from usage where machine is null union all select 'copied', event_index from near) group by all")
def machine_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two machines, a part of which also came to this machine: without ids, with the same or with others. Rows of equal content are rare here."""
    u = b.usage(spark, d)
    n = F.col("event_index")
    mid = F.when(n % 4 != 0, F.concat(F.lit("m"), (n % 1000).cast("string")))
    rid = F.when(n % 6 >= 3, F.concat(F.lit("r"), (n % 7).cast("string")))
    here, far = u.where("machine is null"), u.where("machine is not null").withColumns({"message_id": mid, "request_id": rid})
    none = F.lit(None).cast("string")
    place = n % 15
    copied = far.where("event_index % 5 = 0").withColumns({"machine": none, "message_id": F.when(place < 5, none).when(place < 10, mid).otherwise("other"), "request_id": F.when((place >= 5) & (place < 10), rid)})
    merged = joins.merge_machines(here.withColumn("_c", F.lit(False)).unionByName(copied.withColumn("_c", F.lit(True))), far.withColumn("_c", F.lit(False)))
    label = F.when(F.col("_c"), "copied").otherwise(F.coalesce("machine", F.lit("local")))
    return merged.groupBy(label.alias("machine")).agg(F.count("*").alias("events"), F.sum("event_index").alias("places"))


@query(f"{U} select file, count(*) as events from usage where file in ('f1', 'f2', 'f3') group by file")
def history_departed(spark: SparkSession, d: str) -> DataFrame:
    """Stored events of files that are gone, and a copy of a file that is still there, which serves nothing."""
    u = b.usage(spark, d)
    stored = u.unionByName(u.where("file = 'f5'").withColumn("file", F.lit("f5-old")))
    there = u.where("file not in ('f1', 'f2', 'f3')")
    return joins.departed(stored, there).groupBy("file").agg(F.count("*").alias("events"))


@query(f"{U} select source, session_id, arg_min(repo_root, (ts, repo_root)) filter (repo_root is not null) as root from usage group by all")
def session_roots(spark: SparkSession, d: str) -> DataFrame:
    return joins.session_roots(b.usage(spark, d))


WALK = """moving as (select user_id, event_id, event_type as source, 'g' || user_id % 20 as session_id, ts, epoch_us(ts) // 1000 as ms,
  case user_id % 7 when 0 then '/home/dev/alpha' when 1 then '/home/dev/beta' when 2 then '/home/dev/alpha/packages/core' when 3 then '/srv/app' when 4 then '/home/dev/alpha' when 5 then '/home/dev' end as key from events),
roots as (select source, session_id, arg_min(key, (ts, key)) filter (key is not null) as root from moving group by all),
up as (select m.event_id, m.key, r.root, list_filter(list_transform(range(len(string_split(key, '/')), 1, -1), lambda i: array_to_string(list_slice(string_split(key, '/'), 1, i), '/')), lambda p: p = root or starts_with(p, root || '/')) as c from moving m join roots r using (source, session_id))"""


@query(f"with {WALK} select event_id as event_index, case when key is null then null when root is null or len(c) = 0 then key else list_filter(c, lambda p: list_contains(rs, p))[1] end as project from up, (select list(distinct root) as rs from roots where root is not null)")
def attribute_nearest_root(spark: SparkSession, d: str) -> DataFrame:
    u = b.usage(spark, d).withColumn("session_id", F.concat(F.lit("g"), (F.substring("session_id", 2, 20).cast("bigint") % 20).cast("string")))
    u = u.withColumn("repo_root", text.project_key(F.col("repo_root")))
    return joins.attribute_nearest_root(u).select("event_index", F.col("repo_root").alias("project"))


@query(f"{U} select event_index, case when project = '/home/dev/alpha' then '/work/alpha' when project = '/home/dev/alpha/packages/core' then '/work/alpha/packages/core' when project = '(unattributed)' then null else project end as project from usage")
def alias_moves(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("/home/dev/alpha", "/work/alpha")], "alias string, target string")
    return joins.move_by_aliases(b.usage(spark, d), aliases).select("event_index", text.project_key(F.col("repo_root")).alias("project"))


# cube

CUBE = f"""{U}, cells as (select strftime(ts, '%Y-%m-%d %H:00') as hour, source, coalesce(model, '(unknown)') as model, project, coalesce(machine, 'local') as machine, count(*) as events, {T},
  sum(case when cost_mode = 'explicit' then cost_usd end::varchar::decimal(38,12))::varchar::double as explicit_usd, sum(case when cost_mode = 'estimated' then cost_usd end::varchar::decimal(38,12))::varchar::double as estimated_usd from usage group by all)"""
ROLL = f"sum(events)::bigint as events, sum(total_tokens)::bigint as total_tokens, {MONEY} as cost_usd"


@query(f"{CUBE} select * from cells")
def cube_cells(spark: SparkSession, d: str) -> DataFrame:
    return reports.cube(b.usage(spark, d))


@query(f"{CUBE}, w as (select *, substr(hour, 1, 10)::date as ts from cells) select {WEEK} as week, {ROLL} from w group by all")
def cube_rollup_week(spark: SparkSession, d: str) -> DataFrame:
    return reports.cube_rollup(reports.cube(b.usage(spark, d)), {"week": calendar.iso_week(F.substring("hour", 1, 10).cast("date"))})


@query(f"{CUBE} select project, {ROLL} from cells group by project")
def cube_by_project(spark: SparkSession, d: str) -> DataFrame:
    return reports.cube_rollup(reports.cube(b.usage(spark, d)), ["project"])


@query(f"{CUBE}, r as (select source, row_number() over (order by sum(total_tokens) desc, source) as r from cells group by source) select substr(hour, 1, 10) as day, case when r <= 2 then source else 'Other' end as label, sum(total_tokens)::bigint as total_tokens from cells join r using (source) group by all")
def cube_stack_top_n(spark: SparkSession, d: str) -> DataFrame:
    return reports.stack_top(reports.cube(b.usage(spark, d)), "source", 2)


@query(f"{CUBE} select isodow(substr(hour, 1, 10)::date)::bigint as weekday, substr(hour, 12, 2)::bigint as hour, sum(total_tokens)::bigint as total_tokens, sum(events)::bigint as events from cells group by isodow(substr(hour, 1, 10)::date), substr(hour, 12, 2)")
def cube_hour_weekday(spark: SparkSession, d: str) -> DataFrame:
    return reports.hour_weekday(reports.cube(b.usage(spark, d)))


# scalar functions

PATHS = [("/a/b/", "/a/b", "/a"), ("/", "/", None), ("///", "/", None), ("C:\\", "C:\\", None), ("C:\\x\\", "C:\\x", "C:\\"), ("/x/node_modules/y", "/x", "/"), ("/node_modules/y", "/", None), ("/r/.claude/worktrees/w/sub", "/r", "/"), ("/x", "/x", "/"), ("name", "name", None)]


def values_sql(columns: str, rows: list[tuple]) -> str:
    quote = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") as t({columns})"


@query(values_sql("path, project, parent", PATHS))
def project_key(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(p,) for p, _, _ in PATHS], "path string").withColumn("project", text.project_key(F.col("path")))
    return df.withColumn("parent", text.parent_key(F.col("project")))


@query(f"select distinct l_shipdate::date::varchar as day, {WEEK.replace('ts', 'l_shipdate')} as week from lineitem")
def iso_week_key(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return b.table(spark, d, "lineitem").select(day.cast("string").alias("day"), calendar.iso_week(day).alias("week")).distinct()


PROVIDERS = [("OpenAI-Codex", "openai"), ("openai/x", "openai"), ("github-copilot", "github"), (" Anthropic ", "anthropic"), ("mystery", "mystery"), ("", None), ("kimi-coding", "moonshot")]


@query(values_sql("provider, billed", PROVIDERS))
def normalize_provider(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in PROVIDERS], "provider string").withColumn("billed", text.billing_provider(F.col("provider")))


REMOTES = [("git@github.com:Owner/Repo.git", "github.com/owner/repo"), ("https://user:x@github.com:8443/owner/repo/", "github.com/owner/repo"), ("ssh://git@host.example/a/b.git", "host.example/a/b"), ("not a remote", None)]


@query(values_sql("url, remote", REMOTES))
def git_remote(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u, _ in REMOTES], "url string").withColumn("remote", text.git_remote(F.col("url")))


@query("select conv_id, turn, case when regexp_matches(x, '^[=+@-]') then '''' || x else x end as cell from (select conv_id, turn, case turn % 4 when 0 then '=' || role when 1 then '-' || role when 2 then '@' || role else role end as x from conversations)")
def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "conversations")
    x = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("="), "role")).when(F.col("turn") % 4 == 1, F.concat(F.lit("-"), "role")).when(F.col("turn") % 4 == 2, F.concat(F.lit("@"), "role")).otherwise(F.col("role"))
    return c.select("conv_id", "turn", text.csv_guard(x).alias("cell"))


BOUNDS = [1000, 4000, 8000]


@query(f"{U} select {DAY} as day, source, count(*) as count, sum(total_tokens)::bigint as sum, min(total_tokens) as min, max(total_tokens) as max, " + ", ".join(f"count(*) filter ({test}) as b{i}" for i, test in enumerate(["total_tokens <= 1000", "total_tokens > 1000 and total_tokens <= 4000", "total_tokens > 4000 and total_tokens <= 8000", "total_tokens > 8000"])) + " from usage group by all")
def otlp_histogram(spark: SparkSession, d: str) -> DataFrame:
    from quillmeter.sources.sinks import histogram

    rows = b.usage(spark, d).withColumn("day", calendar.period_key(F.col("ts"), "day"))
    found = histogram(rows, ["day", "source"], "total_tokens", BOUNDS)
    return found.select("day", "source", "count", "sum", "min", "max", *[F.col("buckets")[i].alias(f"b{i}") for i in range(4)])


@query("select event_id, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%d') as day from events")
def normalize_timestamp(spark: SparkSession, d: str) -> DataFrame:
    from quillmeter.sources.raw import timestamp_of

    e = b.table(spark, d, "events")
    shapes = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(calendar.epoch_ms(F.col("ts")).cast("string"))
    at = timestamp_of(shapes)
    return e.select("event_id", calendar.epoch_ms(at).alias("ms"), F.date_format(at, "yyyy-MM-dd").alias("day"))


from quillmeter import catalogue_more  # noqa: E402, F401  (registers further queries)
