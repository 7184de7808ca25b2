"""The normalized rows that test tables stand for: the same expressions in Spark and, as text, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOTS = ["/home/dev/alpha", "/home/dev/beta/", "/home/dev/alpha/packages/core", "/srv/app/node_modules/lib", "/home/dev/alpha/.claude/worktrees/fix", "/home/dev"]
MODELS = ["claude-sonnet-4-5", "gpt-5-codex", "gemini-2.5-pro", "claude-opus-4-1-20250805"]
PROVIDERS = ["anthropic", "openai-codex", "google", "Anthropic "]


def pick(index, values: list[str]):
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: usage rows from events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, u, n = F.col("k"), F.col("user_id"), F.col("event_id")
    out = n % 7 + k * 10
    rows = e.select(
        F.col("event_type").alias("source"), F.concat(F.lit("u"), u.cast("string")).alias("session_id"), "ts",
        pick(u % 7, ROOTS).alias("repo_root"), pick(k % 5, PROVIDERS).alias("provider"), pick(k % 5, MODELS).alias("model"),
        (k * 100 + n % 50).alias("input_tokens"), out.alias("output_tokens"), F.least(out, (k % 4) * 5).alias("reasoning_tokens"),
        ((k % 3) * 1000).alias("cache_read_tokens"), ((k % 2) * 200).alias("cache_write_tokens"), ((k % 2) * 50).alias("cache_write_1h_tokens"),
        (k * 100 + n % 50 + out + (k % 3) * 1000 + (k % 2) * 200).alias("total_tokens"), (n % 2 == 0).alias("single_request"),
        F.when(n % 3 != 0, F.col("value") / 100).alias("cost_usd"), F.when(n % 3 != 0, "explicit").otherwise("estimated").alias("cost_mode"),
        pick(u % 3, ["box1", "box2"]).alias("machine"), F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("request_id"),
        F.concat(F.lit("f"), (u % 10).cast("string")).alias("file"), n.alias("event_index"),
    )
    return rows


def _case(index: str, values: list[str]) -> str:
    return "case " + " ".join(f"when {index} = {i} then '{v}'" for i, v in enumerate(values)) + " end"


USAGE_SQL = f"""e as (
  select *, cast(json_extract_string(props, '$.k') as bigint) as k from events
), usage as (
  select event_type as source, 'u' || user_id as session_id, ts, {_case('user_id % 7', ROOTS)} as repo_root,
    {_case('k % 5', PROVIDERS)} as provider, {_case('k % 5', MODELS)} as model,
    k * 100 + event_id % 50 as input_tokens, event_id % 7 + k * 10 as output_tokens,
    least(event_id % 7 + k * 10, (k % 4) * 5) as reasoning_tokens, (k % 3) * 1000 as cache_read_tokens, (k % 2) * 200 as cache_write_tokens,
    (k % 2) * 50 as cache_write_1h_tokens, k * 100 + event_id % 50 + event_id % 7 + k * 10 + (k % 3) * 1000 + (k % 2) * 200 as total_tokens,
    event_id % 2 = 0 as single_request, case when event_id % 3 <> 0 then value / 100 end as cost_usd,
    case when event_id % 3 <> 0 then 'explicit' else 'estimated' end as cost_mode, {_case('user_id % 3', ['box1', 'box2'])} as machine,
    'f' || user_id % 10 as file, event_id as event_index, epoch_us(ts) // 1000 as ms,
    {{project}} as project
  from e
)"""
# project_key and its label, for the paths above
PROJECT_SQL = "coalesce(case " + " ".join(
    f"when user_id % 7 = {i} then '{p}'" for i, p in enumerate(["/home/dev/alpha", "/home/dev/beta", "/home/dev/alpha/packages/core", "/srv/app", "/home/dev/alpha", "/home/dev"])
) + " end, '(unattributed)')"
USAGE_SQL = USAGE_SQL.replace("{project}", PROJECT_SQL)


def line_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: usage rows at scale, from lineitem and its dimensions; small dimensions are broadcast by their measured size."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("repo_root"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(place, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    tokens = F.col("l_quantity").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return lines.select(F.concat("l_returnflag", "l_linestatus").alias("source"), F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_shipdate").alias("ts"), "repo_root", F.col("p_brand").alias("model"), tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"), zero.alias("reasoning_tokens"), zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens"), (tokens * 3).alias("total_tokens"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_usd"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_index"))


LINES_SQL = """usage as (
  select l_returnflag || l_linestatus as source, l_orderkey::varchar as session_id, l_shipdate as ts, '/' || r_name || '/' || n_name as repo_root, p_brand as model,
    l_quantity::bigint as input_tokens, l_quantity::bigint * 2 as output_tokens, 0 as reasoning_tokens, 0 as cache_read_tokens, 0 as cache_write_tokens,
    l_quantity::bigint * 3 as total_tokens, l_extendedprice * (1 - l_discount) as cost_usd, epoch_us(l_shipdate) // 1000 as ms, '/' || r_name || '/' || n_name as project
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
)"""


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: tool calls from events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, n = F.col("k"), F.col("event_id")
    name = F.when(n % 2 == 0, F.col("event_type")).otherwise(F.initcap("event_type"))
    status = F.when(k % 3 == 0, "ok").when(k % 3 == 1, "error").otherwise("unknown")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), "ts", (F.col("user_id") * 1000 + k).cast("string").alias("call_id"), name.alias("name"), status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("bigint").alias("duration_ms"), F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")).alias("file"), n.alias("event_index"))


CALLS_SQL = """e as (
  select *, cast(json_extract_string(props, '$.k') as bigint) as k from events
), calls as (
  select 's' || user_id % 3 as source, 'u' || user_id as session_id, ts, (user_id * 1000 + k)::varchar as call_id,
    case when event_id % 2 = 0 then event_type else upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) end as name,
    case k % 3 when 0 then 'ok' when 1 then 'error' else 'unknown' end as status, event_id as event_index from e
)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: commits from orders, moved to the year of events."""
    price = F.floor("o_totalprice").cast("bigint")
    o = table(spark, sf_dir, "orders")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(days=(F.col("o_orderkey") % 40).cast("int"))
    return o.select(ts.alias("ts"), (price % 500).alias("added"), (price % 90).alias("deleted"))


COMMITS_SQL = """commits as (
  select timestamp '2024-01-01 00:00:00' + to_days((o_orderkey % 40)::int) as ts, floor(o_totalprice)::bigint % 500 as added, floor(o_totalprice)::bigint % 90 as deleted from orders
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: messages from conversations."""
    return table(spark, sf_dir, "conversations").select(F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("session_id"), "role", F.char_length("text").cast("bigint").alias("text_length"), F.col("turn").alias("event_index"))
