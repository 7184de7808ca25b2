"""Usage rows from the session logs of coding tools: JSONL and JSON formats.

Each reader takes (spark, path) and returns rows of raw.usage_rows, rejects included. Order
within a file matters to some; it is the order of lines, never a file's time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import numbers
from quillmeter.sources.codex import codex
from quillmeter.sources.raw import count, documents, first_time, get, items, lines, session_of, timestamp_of, usage_rows, word


def _numbered(df: DataFrame) -> DataFrame:
    """line as a number: places of the lines of a file from 0 on."""
    return df.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("bigint") - 1)


def _carried(value: Column, order: str = "line") -> Column:
    """The last value so far in the file."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _prompt(total: Column, cached: Column) -> Column:
    """A prompt that includes its cached tokens, without them."""
    return F.greatest(F.lit(0), total - cached)


def claude(spark: SparkSession, path: str) -> DataFrame:
    """Assistant rows with usage; of rows with the same message and request in a file the last counts.

    A subagent's transcript is a fork where the .meta.json beside it says so; the parent is the
    agent named there or the main session. Rows that its parent has as well are the parent's.
    """
    raw = lines(spark, path, "*.jsonl", ["usage"]).where(get("j", "$.type") == "assistant").where(F.try_variant_get("j", "$.message.usage", "variant").isNotNull())
    model = word("j", "$.message.model")
    raw = raw.where(model.isNull() | (model != "<synthetic>"))
    key = F.coalesce(F.when(word("j", "$.message.id").isNotNull(), F.concat_ws("\x00", word("j", "$.message.id"), word("j", "$.requestId"))), word("j", "$.uuid"), F.concat_ws("\x00", get("j", "$.timestamp"), model))
    u = "$.message.usage."
    output = count("j", u + "output_tokens")
    parts = {"input_tokens": count("j", u + "input_tokens"), "output_tokens": output, "reasoning_tokens": F.least(output, count("j", u + "output_tokens_details.thinking_tokens")), "cache_read_tokens": count("j", u + "cache_read_input_tokens"), "cache_write_tokens": count("j", u + "cache_creation_input_tokens"), "cache_write_1h_tokens": count("j", u + "cache_creation.ephemeral_1h_input_tokens")}
    facts = {"session": F.coalesce(word("j", "$.sessionId"), session_of(F.col("file"))), "at": first_time("j", "$.timestamp"), "cwd": word("j", "$.cwd"), "model": word("j", "$.message.model"), "mid": word("j", "$.message.id"), "rid": word("j", "$.requestId")}
    # only what is read from a line travels, once, to the other lines of its file
    rows = raw.select("file", "line", key.alias("_key"), *[v.alias(k) for k, v in {**parts, **facts}.items()]).repartition("file")
    last = F.row_number().over(Window.partitionBy("file", "_key").orderBy(F.col("line").desc()))
    rows = _numbered(rows.withColumn("_last", last).where("_last = 1"))
    told = documents(spark, path, "agent-*.meta.json").where(F.try_variant_get("j", "$.isFork", "boolean"))
    folder, agent = F.regexp_replace("file", "/[^/]+$", ""), word("j", "$.parentAgentId")
    parent = F.when(agent.isNull(), F.concat(F.regexp_replace(folder, "/[^/]+$", ""), F.lit(".jsonl"))).otherwise(F.concat(folder, F.lit("/agent-"), agent, F.lit(".jsonl")))
    forks = told.select(F.regexp_replace("file", r"\.meta\.json$", ".jsonl").alias("file"), parent.alias("_parent")).dropDuplicates(["file"])
    theirs = rows.select(F.col("file").alias("_parent"), "_key").join(forks.select("_parent").distinct(), "_parent", "left_semi")
    rows = rows.join(forks, "file", "left").join(theirs, ["_parent", "_key"], "left_anti")
    return usage_rows(rows, "claude", session_id=F.col("session"), ts=F.col("at"), repo_root=F.col("cwd"), provider=F.lit("anthropic"), model=F.col("model"), single_request=F.lit(True), message_id=F.col("mid"), request_id=F.col("rid"), event_index=F.col("line"), **{k: F.col(k) for k in parts})


def qwen(spark: SparkSession, path: str) -> DataFrame:
    """Assistant lines; prompts include cached tokens, and thoughts count beside candidates where the total says so."""
    raw = _numbered(lines(spark, path, "*.jsonl", ["usageMetadata"]).where(get("j", "$.type") == "assistant"))
    u = "$.usageMetadata."
    prompt, said, thought, cached, total = (count("j", u + n) for n in ("promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount", "cachedContentTokenCount", "totalTokenCount"))
    apart = (thought > said) | (total == prompt + said + thought)
    return usage_rows(raw, "qwen", session_id=F.coalesce(word("j", "$.sessionId"), session_of(F.col("file"))), ts=first_time("j", "$.timestamp"), repo_root=word("j", "$.cwd"), provider=F.lit("qwen"), model=word("j", "$.model"), input_tokens=_prompt(prompt, cached), output_tokens=F.when(apart, said + thought).otherwise(said), reasoning_tokens=thought, cache_read_tokens=F.least(cached, prompt), total_tokens=total, event_index=F.col("line"))


def gemini(spark: SparkSession, path: str) -> DataFrame:
    """Chats as one JSON document each; tool tokens are input, thoughts output. projects.json maps paths to hashes."""
    docs = documents(spark, path, "*.json")
    chats = items(docs.where(F.col("file").contains("/chats/")), "$.messages").where(get("x", "$.type") == "gemini")
    names = docs.where(F.col("file").endswith("/projects.json")).select(F.explode(F.try_variant_get("j", "$.projects", "map<string,string>")).alias("root", "short"))
    roots = names.select(F.sha2(F.col("root").cast("binary"), 256).alias("_hash"), "root").unionByName(names.select(F.col("short").alias("_hash"), "root")).dropDuplicates(["_hash"])
    folder = F.element_at(F.split("file", "/"), -3)
    chats = chats.withColumn("_hash", F.coalesce(word("j", "$.projectHash"), folder)).join(roots, "_hash", "left")
    t = "$.tokens."
    prompt, tool, said, thought, cached, total = (count("x", t + n) for n in ("input", "tool", "output", "thoughts", "cached", "total"))
    return usage_rows(chats, "gemini", session_id=F.coalesce(word("j", "$.sessionId"), session_of(F.col("file"))), ts=first_time("x", "$.timestamp"), repo_root=F.col("root"), provider=F.lit("google"), model=word("x", "$.model"), input_tokens=_prompt(prompt, cached) + tool, output_tokens=said + thought, reasoning_tokens=thought, cache_read_tokens=F.least(cached, prompt), total_tokens=total, event_index=F.col("line").cast("bigint"))


def droid(spark: SparkSession, path: str) -> DataFrame:
    """One row a session from its settings; the log beside them has the directory and, failing a time there, the first one."""
    settings = documents(spark, path, "*.settings.json").withColumn("_stem", F.regexp_replace("file", r"\.settings\.json$", ""))
    log = lines(spark, path, "*.jsonl", ["session_start", "message"]).withColumn("_stem", F.regexp_replace("file", r"\.jsonl$", ""))
    about = log.groupBy("_stem").agg(F.min_by(word("j", "$.session_start.cwd", "$.cwd"), F.when(word("j", "$.session_start.cwd", "$.cwd").isNotNull(), F.col("line"))).alias("_cwd"), F.min_by(get("j", "$.timestamp"), F.when((get("j", "$.type") == "message") & get("j", "$.timestamp").isNotNull(), F.col("line"))).alias("_time"))
    both = settings.join(about, "_stem", "left")
    u = "$.tokenUsage."
    return usage_rows(both, "droid", session_id=session_of(F.col("file")), ts=F.coalesce(first_time("j", "$.providerLockTimestamp"), timestamp_of(F.col("_time"))), repo_root=F.col("_cwd"), provider=word("j", "$.providerLock"), model=word("j", "$.model"), input_tokens=count("j", u + "inputTokens"), output_tokens=count("j", u + "outputTokens"), reasoning_tokens=count("j", u + "thinkingTokens"), cache_read_tokens=count("j", u + "cacheReadTokens"), cache_write_tokens=count("j", u + "cacheCreationTokens"))


def pi(spark: SparkSession, path: str) -> DataFrame:
    """Messages with usage; session, model and provider carry on from earlier lines.

    What a fork copied, older than itself, is its parent's: it is left out where the parent's log
    is in the scan, else it counts under the parent's session, which the log's name tells.
    """
    raw = lines(spark, path, "*.jsonl")
    kind = get("j", "$.type")
    head = lambda p: F.when(kind == "session", word("j", p))
    rows = raw.withColumns({"_session": _carried(head("$.id")), "_cwd": _carried(head("$.cwd")), "_parent": _carried(head("$.parentSession")), "_born": _carried(F.when(kind == "session", get("j", "$.timestamp"))), "_model": _carried(F.coalesce(F.when(kind == "model_change", word("j", "$.modelId")), word("j", "$.model", "$.message.model"))), "_provider": _carried(F.coalesce(F.when(kind == "model_change", word("j", "$.provider")), word("j", "$.provider", "$.message.provider")))})
    rows = _numbered(rows.where((kind == "message") & F.coalesce(F.try_variant_get("j", "$.usage", "variant"), F.try_variant_get("j", "$.message.usage", "variant")).isNotNull()))
    born, at_ = timestamp_of(F.col("_born")), timestamp_of(get("j", "$.timestamp"))
    copied = F.coalesce(F.col("_parent").isNotNull() & (at_ < born), F.lit(False))
    # a parent is named by its path, absolute or from the fork's folder
    name = F.element_at(F.split("_parent", "/"), -1)
    there = raw.select(F.element_at(F.split("file", "/"), -1).alias("_name"), F.col("file").alias("_there")).distinct()
    above = F.when(F.col("_parent").startswith("/"), F.col("_there").endswith(F.col("_parent"))).otherwise(F.col("_there") == F.concat(F.regexp_replace("file", "/[^/]+$", "/"), F.regexp_replace("_parent", r"^(\./)+", "")))
    rows = rows.withColumns({"_copied": copied, "_name": F.when(copied, name)})
    rows = rows.join(there, (rows._name == there._name) & above, "left_anti")
    stem = F.regexp_extract("_parent", r"_([^/_]+)\.jsonl$", 1)
    rows = rows.withColumn("_session", F.when(F.col("_copied") & (stem != ""), stem).otherwise(F.col("_session")))
    at = lambda n: ("$.usage." + n, "$.message.usage." + n)
    return usage_rows(rows, "pi", session_id=F.coalesce("_session", session_of(F.col("file"))), ts=first_time("j", "$.timestamp", "$.message.timestamp"), repo_root=F.col("_cwd"), provider=F.col("_provider"), model=F.col("_model"), input_tokens=count("j", *at("input")), output_tokens=count("j", *at("output")), reasoning_tokens=count("j", *at("reasoning"), *at("reasoningTokens"), *at("reasoningOutput"), *at("outputReasoning")), cache_read_tokens=count("j", *at("cacheRead")), cache_write_tokens=count("j", *at("cacheWrite")), total_tokens=count("j", *at("totalTokens")), cost_usd=numbers.usd(get("j", *at("cost.total"))), event_index=F.col("line"))


def openclaw(spark: SparkSession, path: str) -> DataFrame:
    """Messages under many spellings of their fields; copies that only mirror a delivery are left out."""
    raw = lines(spark, path, "*.jsonl")
    # The spellings below are those that the logs use.
    both = lambda *names: [f"{p}.{n}" for n in names for p in ("$", "$.message")]
    provider, model = word("j", *both("provider", "modelProvider", "model_provider")), word("j", *both("model", "modelId", "model_id"))
    is_session = get("j", "$.type") == "session"
    rows = raw.withColumns({"_provider": _carried(provider), "_model": _carried(model), "_cwd": _carried(word("j", *both("cwd"))), "_session": _carried(F.when(is_session, word("j", "$.id"))), "_start": _carried(F.when(is_session, get("j", "$.timestamp")))})
    usage = lambda *names: [f"{p}.usage.{n}" for p in ("$", "$.message") for n in names]
    cached_names = ("cacheRead", "cache_read", "cacheReadTokens", "cache_read_tokens", "cached", "cached_input_tokens")
    cached, named, prompt = get("j", *usage(*cached_names)), get("j", *usage("input", "inputTokens", "input_tokens")), get("j", *usage("prompt_tokens"))
    rows = _numbered(rows.where(~is_session & F.coalesce(F.try_variant_get("j", "$.usage", "variant"), F.try_variant_get("j", "$.message.usage", "variant")).isNotNull()))
    mirror = (F.lower(F.coalesce(provider, F.lit(""))) == "openclaw") | (F.lower(F.coalesce(model, F.lit(""))) == "delivery-mirror") | (F.lower(F.coalesce(word("j", "$.message.kind", "$.message.source", "$.message.provenance"), F.lit(""))) == "delivery-mirror")
    n = numbers.non_negative_int
    inputs = F.when(named.isNotNull(), n(named)).otherwise(_prompt(n(prompt), n(cached)))
    price = numbers.usd(get("j", *usage("costUsd", "cost_usd", "turnUsd", "turn_usd", "usd", "cost", "cost.total", "cost.usd", "cost.turnUsd", "cost.turn_usd")))
    return usage_rows(rows.where(~mirror), "openclaw", session_id=F.coalesce("_session", session_of(F.col("file"))), ts=F.coalesce(first_time("j", "$.timestamp", "$.message.timestamp"), timestamp_of(F.col("_start"))), repo_root=F.col("_cwd"), provider=F.col("_provider"), model=F.col("_model"), input_tokens=inputs, output_tokens=n(get("j", *usage("output", "outputTokens", "output_tokens", "completion_tokens"))), reasoning_tokens=n(get("j", *usage("reasoning", "reasoningTokens", "reasoning_tokens", "reasoningOutput", "reasoning_output_tokens"))), cache_read_tokens=n(cached), cache_write_tokens=n(get("j", *usage("cacheWrite", "cache_write", "cacheWriteTokens", "cache_write_tokens"))), total_tokens=n(get("j", *usage("total", "totalTokens", "total_tokens"))), cost_usd=price, event_index=F.col("line"))


def copilot(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry spans of four classes; a lower class only counts where no higher one kept its trace or response.

    Four anti-joins in turn, each against what was kept before; then one row a span.
    """
    raw = _numbered(lines(spark, path, "*.jsonl", ["gen_ai"]))
    a = lambda n: f"$.attributes['{n}']"
    operation, name, body = get("j", a("gen_ai.operation.name")), F.coalesce(get("j", "$.name"), F.lit("")), F.coalesce(get("j", "$.body", "$.body.stringValue"), F.lit(""))
    event = F.coalesce(get("j", a("event.name"), "$['event.name']", "$.event.name"), F.lit(""))
    kind = F.when((operation == "chat") | name.startswith("chat "), 1).when((event == "gen_ai.client.inference.operation.details") | body.startswith("GenAI inference:"), 2).when((event == "copilot_chat.agent.turn") | body.startswith("copilot_chat.agent.turn"), 3).when((operation == "invoke_agent") | name.startswith("invoke_agent "), 4)
    rows = raw.withColumns({"_class": kind, "_trace": word("j", "$.traceId", "$.spanContext.traceId"), "_span": word("j", "$.spanId", "$.spanContext.spanId"), "_response": word("j", a("gen_ai.response.id"))}).where("_class is not null")
    kept = rows.where("_class = 1")
    for k in (2, 3, 4):
        mine = rows.where(F.col("_class") == k)
        traces = kept.select("_trace").where("_trace is not null").distinct()
        responses = kept.select("_response").where("_response is not null").distinct()
        kept = kept.unionByName(mine.join(traces, "_trace", "left_anti").select(*rows.columns).join(responses, "_response", "left_anti").select(*rows.columns))
    session = F.coalesce(word("j", a("gen_ai.conversation.id"), a("copilot_chat.session_id"), a("session.id")), F.col("_trace"), session_of(F.col("file")))
    same = F.when(F.col("_span").isNotNull(), F.concat_ws("\x00", F.coalesce("_trace", session), "_span")).otherwise(F.col("line").cast("string"))
    kept = kept.withColumn("_same", same).withColumn("_n", F.row_number().over(Window.partitionBy("file", "_same").orderBy("line"))).where("_n = 1")
    g = lambda *n: count("j", *[a(f"gen_ai.usage.{x}") for x in n])
    cached, written = g("cache_read.input_tokens", "cache_read_input_tokens"), g("cache_creation.input_tokens", "cache_creation_input_tokens")
    nanos = lambda p: timestamp_of((get("j", p).try_cast("double") / 1e6).cast("decimal(20,0)").cast("string"))
    hr = lambda p: timestamp_of((get("j", f"$.{p}[0]").try_cast("double") * 1000 + F.floor(get("j", f"$.{p}[1]").try_cast("double") / 1e6)).cast("decimal(20,0)").cast("string"))
    ts = F.coalesce(*[hr(p) for p in ("endTime", "startTime", "hrTime", "_hrTime", "time")], first_time("j", "$.timestamp", "$.observedTimestamp"), nanos("$.timeUnixNano"))
    return usage_rows(kept, "copilot", session_id=session, ts=ts, provider=F.lit("github-copilot"), model=word("j", a("gen_ai.response.model"), a("gen_ai.request.model")), input_tokens=_prompt(g("input_tokens"), cached + written), output_tokens=g("output_tokens"), reasoning_tokens=g("reasoning.output_tokens", "reasoning_tokens"), cache_read_tokens=cached, cache_write_tokens=written, message_id=F.col("_response"), event_index=F.col("line"))


def amp(spark: SparkSession, path: str) -> DataFrame:
    """Threads: events of the ledger where there are any, joined to their message for cache tokens; else usage of messages."""
    docs = documents(spark, path, "*.json")
    n = F.coalesce(F.size(F.try_variant_get("j", "$.usageLedger.events", "array<variant>")), F.lit(0))
    said = items(docs, "$.messages").where(F.try_variant_get("x", "$.usage", "variant").isNotNull())
    about = said.select("file", word("x", "$.id").alias("_to"), count("x", "$.usage.cacheReadInputTokens").alias("_read"), count("x", "$.usage.cacheCreationInputTokens").alias("_written")).where("_to is not null").dropDuplicates(["file", "_to"])
    booked = items(docs.where(n > 0), "$.usageLedger.events").withColumn("_to", word("x", "$.toMessageId")).join(about, ["file", "_to"], "left")
    first = lambda df: df.withColumn("_id", F.coalesce(word("x", "$.id"), F.concat(F.lit("#"), F.col("line").cast("string")))).withColumn("_n", F.row_number().over(Window.partitionBy("file", "_id").orderBy("line"))).where("_n = 1")
    session = F.coalesce(word("j", "$.id"), session_of(F.col("file")))
    none = F.lit(0).cast("bigint")
    ledger = usage_rows(first(booked), "amp", session_id=session, ts=first_time("x", "$.timestamp"), model=word("x", "$.model"), input_tokens=count("x", "$.tokens.input"), output_tokens=count("x", "$.tokens.output"), cache_read_tokens=F.coalesce("_read", none), cache_write_tokens=F.coalesce("_written", none), message_id=word("x", "$.id"), event_index=F.col("line").cast("bigint"))
    plain = usage_rows(first(said.where(n == 0)), "amp", session_id=session, ts=F.coalesce(first_time("x", "$.timestamp", "$.usage.timestamp"), first_time("j", "$.created")), model=word("x", "$.usage.model", "$.model"), input_tokens=count("x", "$.usage.inputTokens"), output_tokens=count("x", "$.usage.outputTokens"), cache_read_tokens=count("x", "$.usage.cacheReadInputTokens"), cache_write_tokens=count("x", "$.usage.cacheCreationInputTokens"), total_tokens=count("x", "$.usage.totalTokens"), message_id=word("x", "$.id"), event_index=F.col("line").cast("bigint"))
    return ledger.unionByName(plain)


# Fixed value: the instant from which files without a model mean the newer one.
KIMI_CUTOFF, KIMI_OLD, KIMI_NEW = "2026-04-20 15:28:10.072", "kimi-k2.5", "kimi-k2.6"


def kimi(spark: SparkSession, path: str) -> DataFrame:
    """Status updates; of those of one message the one with most tokens, then the newest."""
    raw = _numbered(lines(spark, path, "wire.jsonl", ["StatusUpdate", "usage.record"]))
    u = "$.message.payload.token_usage."
    parts = {"input_tokens": count("j", u + "input_other"), "output_tokens": count("j", u + "output"), "cache_read_tokens": count("j", u + "input_cache_read"), "cache_write_tokens": count("j", u + "input_cache_creation")}
    rows = raw.where(get("j", "$.message.type") == "StatusUpdate").withColumns(parts).withColumns({"_id": word("j", "$.message.payload.message_id"), "_ts": first_time("j", "$.timestamp")})
    size = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    best = F.row_number().over(Window.partitionBy("file", F.coalesce("_id", F.col("line").cast("string"))).orderBy(size.desc(), F.col("_ts").desc(), "line"))
    rows = rows.withColumn("_n", best).where("_n = 1")
    model = F.when(F.col("_ts") < F.lit(KIMI_CUTOFF).cast("timestamp_ntz"), KIMI_OLD).otherwise(KIMI_NEW)
    status = usage_rows(rows, "kimi", session_id=F.element_at(F.split("file", "/"), -2), ts=F.col("_ts"), provider=F.lit("moonshot"), model=model, total_tokens=count("j", u + "total"), message_id=F.col("_id"), event_index=F.col("line"), **{k: F.col(k) for k in parts})
    code = raw.where((get("j", "$.type") == "usage.record") & (F.coalesce(get("j", "$.usageScope"), F.lit("turn")) == "turn"))
    turns = usage_rows(code, "kimi", session_id=F.element_at(F.split("file", "/"), -4), ts=first_time("j", "$.time", "$.timestamp"), provider=F.lit("moonshot"), model=F.regexp_replace(word("j", "$.model"), "^kimi-code/", ""), input_tokens=count("j", "$.usage.inputOther"), output_tokens=count("j", "$.usage.output"), cache_read_tokens=count("j", "$.usage.inputCacheRead"), cache_write_tokens=count("j", "$.usage.inputCacheCreation"), event_index=F.col("line"))
    return status.unionByName(turns)


def cline_family(spark: SparkSession, path: str, source: str = "cline") -> DataFrame:
    """Requests of task files; roocode and kilocode count cached tokens of some protocols in their input. A cost of 0 is none."""
    tasks = items(documents(spark, path, "ui_messages.json"), "$").where((get("x", "$.type") == "say") & (get("x", "$.say") == "api_req_started"))
    tasks = tasks.withColumn("p", F.try_parse_json(get("x", "$.text")))
    history = documents(spark, path, "api_conversation_history.json").select(F.regexp_replace("file", "/[^/]+$", "").alias("_dir"), F.regexp_extract(F.to_json("j"), r"<model>([^<]+)</model>", 1).alias("_model"))
    tasks = tasks.withColumn("_dir", F.regexp_replace("file", "/[^/]+$", "")).join(history, "_dir", "left")
    read, written, given = count("p", "$.cacheReads"), count("p", "$.cacheWrites"), count("p", "$.tokensIn")
    inputs = F.greatest(F.lit(0), given - read - written) if source in ("roocode", "kilocode") else given
    price = numbers.usd(get("p", "$.cost"))
    return usage_rows(tasks, source, session_id=F.element_at(F.split("file", "/"), -2), ts=timestamp_of(get("x", "$.ts")), provider=word("p", "$.apiProtocol"), model=F.col("_model"), input_tokens=inputs, output_tokens=count("p", "$.tokensOut"), cache_read_tokens=read, cache_write_tokens=written, cost_usd=F.when(price > 0, price), event_index=F.col("line").cast("bigint"))


def dsh(spark: SparkSession, path: str) -> DataFrame:
    """Assistant messages; provider and model carry on."""
    raw = lines(spark, path, None, ["session", "assistant"])
    head = get("j", "$.type") == "session"
    rows = raw.withColumns({"_session": _carried(F.when(head, word("j", "$.id"))), "_cwd": _carried(F.when(head, word("j", "$.cwd"))), "_provider": _carried(word("j", "$.data.message.source.provider", "$.data.source.provider")), "_model": _carried(word("j", "$.data.message.source.model", "$.data.source.model"))})
    rows = _numbered(rows.where(get("j", "$.type") == "assistant/message"))
    u = "$.data.usage."
    cached = count("j", u + "cacheReadTokens")
    return usage_rows(rows, "dsh", session_id=F.coalesce("_session", session_of(F.col("file"))), ts=first_time("j", "$.time"), repo_root=F.col("_cwd"), provider=F.col("_provider"), model=F.col("_model"), input_tokens=count("j", u + "inputTokens"), output_tokens=count("j", u + "outputTokens"), reasoning_tokens=count("j", u + "reasoningTokens"), cache_read_tokens=cached, cache_write_tokens=count("j", u + "cacheWriteTokens"), total_tokens=count("j", u + "totalTokens"), event_index=F.col("line"))


def claude_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """(source, session_id, ts, call_id, name, status, completed_at, duration_ms, file, event_index) of tool_use blocks and their results."""
    from quillmeter.operators.joins import pair_calls

    raw = lines(spark, path, "*.jsonl", ["tool_use", "tool_result"])
    blocks = raw.select("file", "line", "j", F.explode(F.try_variant_get("j", "$.message.content", "array<variant>")).alias("x"))
    session = F.coalesce(word("j", "$.sessionId"), session_of(F.col("file")))
    ts = first_time("j", "$.timestamp")
    calls = blocks.where(get("x", "$.type") == "tool_use").select(F.lit("claude").alias("source"), session.alias("session_id"), ts.alias("ts"), word("x", "$.id").alias("call_id"), word("x", "$.name").alias("name"), "file", "line")
    results = blocks.where(get("x", "$.type") == "tool_result").select("file", "line", word("x", "$.tool_use_id").alias("call_id"), ts.alias("ts"), F.coalesce(F.try_variant_get("x", "$.is_error", "boolean"), F.lit(False)).alias("is_error"))
    paired = pair_calls(calls.where("name is not null"), results)
    return _numbered(paired).withColumnRenamed("line", "event_index")


READERS = {"claude": claude, "codex": codex, "pi": pi, "gemini": gemini, "droid": droid, "openclaw": openclaw, "copilot": copilot, "amp": amp, "qwen": qwen, "kimi": kimi, "dsh": dsh, "cline": cline_family, "roocode": lambda s, p: cline_family(s, p, "roocode"), "kilocode": lambda s, p: cline_family(s, p, "kilocode")}
