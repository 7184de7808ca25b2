"""Properties of operators, and readers, exports and streams on files of our own."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import text
from quillmeter.functions.calendar import day_start_utc, period_key
from quillmeter.operators import dedupe, windows
from quillmeter.plans import bindings
from quillmeter.schema import USAGE
from quillmeter.sources import gitlog, logs, raw, sinks, sqlite
from quillmeter.streaming import ingest

SF = "/root/testdata/sf0.001"


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def events(df, *columns):
    return sorted(tuple(r) for r in raw.good(df).select(*columns).collect())


def test_repeated_files_keep_the_most(spark):
    rnd = random.Random(3)
    rows = [(f"f{rnd.randrange(4)}", rnd.randrange(6), i) for i in range(80)]
    df = spark.createDataFrame(rows, "file string, v int, event_index long")
    once = dedupe.repeated_across_files(df, F.col("v"))
    most = {}
    for v in range(6):
        most[v] = max(sum(1 for f, x, _ in rows if f == g and x == v) for g in ("f0", "f1", "f2", "f3"))
    assert {r["v"]: r["n"] for r in once.groupBy("v").agg(F.count("*").alias("n")).collect()} == {v: n for v, n in most.items() if n}


def test_blocks_match_a_plain_fold(spark):
    rnd = random.Random(5)
    ms = sorted(rnd.randrange(0, 40 * 3_600_000) for _ in range(60)) + [200 * 3_600_000, 205 * 3_600_000]
    df = spark.createDataFrame([("a", m) for m in ms], "source string, ms long").withColumn("ts", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0,0,0, cast(ms/1000 as decimal(18,6)))"))
    got = [tuple(r) for r in windows.block_starts(df).orderBy("ms").select("ms", "block_start_ms").collect()]
    start, want = None, []
    for m in ms:
        if start is None or m >= start + 5 * 3_600_000:
            start = m // 3_600_000 * 3_600_000
        want.append((m, start))
    assert got == want


def test_clock_gaps_and_folds(spark):
    row = spark.range(1).select(day_start_utc(F.lit("2018-11-04").cast("date"), "America/Sao_Paulo").cast("string").alias("a"), period_key(F.lit("2024-10-27 00:30:00").cast("timestamp_ntz"), "hour", "Europe/Paris").alias("b"), period_key(F.lit("2024-10-27 01:30:00").cast("timestamp_ntz"), "hour", "Europe/Paris").alias("c"), period_key(F.lit("2021-01-03 12:00:00").cast("timestamp_ntz"), "week").alias("d")).first()
    assert row["a"].startswith("2018-11-04 03:00:00") and row["b"] == row["c"] and row["d"] == "2020-W53"


def test_timestamps(spark):
    cases = [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T05:04:05+02:00", "2024-01-02 03:04:05"), ("2024-01-01T22:04:05-0500", "2024-01-02 03:04:05"), ("1704164645", "2024-01-02 03:04:05"), ("1704164645000", "2024-01-02 03:04:05"), ("12345", None), ("soon", None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string").select("t", raw.timestamp_of(F.col("t")).cast("string").alias("x"))
    assert {r["t"]: r["x"] for r in df.collect()} == dict(cases)


def test_claude_keeps_the_last_of_a_request_and_drops_forked_rows(spark, tmp_path):
    usage = lambda n: {"input_tokens": n, "output_tokens": 5, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 4, "cache_creation": {"ephemeral_1h_input_tokens": 9}}
    row = lambda i, n, r="r1": {"type": "assistant", "timestamp": f"2026-01-01T00:00:0{n}Z", "sessionId": "s", "cwd": "/p", "requestId": r, "message": {"id": i, "model": "Claude-X", "usage": usage(n)}}
    lines(tmp_path / "s.jsonl", [row("m1", 1), row("m1", 3), row("m2", 2), '{"usage" broken', {"type": "assistant", "message": {"model": "<synthetic>", "usage": usage(8)}}])
    lines(tmp_path / "s" / "x.jsonl", [])
    lines(tmp_path / "s" / "subagents" / "agent-1.jsonl", [row("m1", 3), row("m9", 7)])
    got = events(logs.claude(spark, str(tmp_path)), "message_id", "input_tokens", "cache_write_1h_tokens", "total_tokens", "model")
    assert ("m1", 3, 4, 14, "claude-x") in got and ("m2", 2, 4, 13, "claude-x") in got and ("m9", 7, 4, 18, "claude-x") in got


def test_codex_differences(spark, tmp_path):
    t = lambda i, c, o: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 0}
    count = lambda total, last, s: {"timestamp": f"2026-01-01T00:00:0{s}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}
    lines(tmp_path / "a.jsonl", [{"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sid", "cwd": "/w", "model_provider": "openai"}}, {"type": "turn_context", "payload": {"model": "gpt-5"}}, count(t(100, 40, 10), t(100, 40, 10), 1), count(t(100, 40, 10), t(100, 40, 10), 2), count(t(250, 90, 30), t(150, 50, 20), 3), count(t(20, 0, 5), t(20, 0, 5), 4)])
    got = events(logs.codex(spark, str(tmp_path)), "event_index", "session_id", "model", "input_tokens", "cache_read_tokens", "output_tokens", "single_request")
    assert [g[1:] for g in got] == [("sid", "gpt-5", 60, 40, 10, True), ("sid", "gpt-5", 100, 50, 20, True), ("sid", "gpt-5", 20, 0, 5, True)]


def test_other_readers(spark, tmp_path):
    lines(tmp_path / "q" / "a.jsonl", [{"type": "assistant", "model": "q", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 4, "thoughtsTokenCount": 3, "cachedContentTokenCount": 2, "totalTokenCount": 17}}])
    assert events(logs.qwen(spark, str(tmp_path / "q")), "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens") == [(8, 7, 2, 17)]
    lines(tmp_path / "p" / "a.jsonl", [{"type": "session", "id": "s1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/c"}, {"type": "model_change", "provider": "openai", "modelId": "gpt-5"}, {"type": "message", "timestamp": "2026-01-01T00:01:00Z", "usage": {"input": 5, "output": 6, "cost": {"total": 0.5}}}])
    assert events(logs.pi(spark, str(tmp_path / "p")), "session_id", "model", "repo_root", "total_tokens", "cost_usd") == [("s1", "gpt-5", "/c", 11, 0.5)]
    lines(tmp_path / "k" / "g" / "sess" / "wire.jsonl", [{"timestamp": "2026-05-01T00:00:0%dZ" % i, "message": {"type": "StatusUpdate", "payload": {"message_id": "m", "token_usage": {"input_other": n, "output": 1}}}} for i, n in ((1, 5), (2, 9), (3, 7))])
    assert events(logs.kimi(spark, str(tmp_path / "k")), "session_id", "input_tokens", "model") == [("sess", 9, "kimi-k2.6")]
    task = tmp_path / "c" / "task-1" / "ui_messages.json"
    task.parent.mkdir(parents=True)
    task.write_text(json.dumps([{"type": "say", "say": "api_req_started", "ts": 1767225600000, "text": json.dumps({"tokensIn": 10, "tokensOut": 2, "cacheReads": 3, "cost": 0})}, {"type": "say", "say": "text"}]))
    assert events(logs.cline_family(spark, str(tmp_path / "c")), "session_id", "input_tokens", "cost_usd") == [("task-1", 10, None)]
    assert events(logs.READERS["roocode"](spark, str(tmp_path / "c")), "session_id", "input_tokens") == [("task-1", 7)]
    amp = tmp_path / "a" / "t.json"
    amp.parent.mkdir(parents=True)
    amp.write_text(json.dumps({"id": "T", "created": 1767225600000, "messages": [{"id": "m1", "usage": {"cacheReadInputTokens": 7}}], "usageLedger": {"events": [{"id": "e1", "timestamp": "2026-01-01T00:00:00Z", "model": "x", "tokens": {"input": 1, "output": 2}, "toMessageId": "m1"}]}}))
    assert events(logs.amp(spark, str(tmp_path / "a")), "session_id", "input_tokens", "cache_read_tokens") == [("T", 1, 7)]
    chat = tmp_path / "g" / "tmp" / "proj" / "chats" / "s.json"
    chat.parent.mkdir(parents=True)
    chat.write_text(json.dumps({"sessionId": "G", "messages": [{"type": "gemini", "timestamp": "2026-01-01T00:00:00Z", "model": "gemini-x", "tokens": {"input": 10, "output": 3, "thoughts": 2, "cached": 4, "tool": 1}}]}))
    (tmp_path / "g" / "projects.json").write_text(json.dumps({"projects": {"/home/x": "proj"}}))
    assert events(logs.gemini(spark, str(tmp_path / "g")), "session_id", "repo_root", "input_tokens", "output_tokens", "total_tokens") == [("G", "/home/x", 7, 5, 16)]
    span = lambda name, trace, sid, n: {"name": name, "traceId": trace, "spanId": sid, "timestamp": "2026-01-01T00:00:00Z", "attributes": {"gen_ai.usage.input_tokens": n, "gen_ai.response.model": "m"}}
    lines(tmp_path / "o" / "a.jsonl", [span("chat m", "t1", "a", 5), span("chat m", "t1", "a", 5), span("invoke_agent x", "t1", "b", 50), span("invoke_agent x", "t2", "c", 9)])
    assert events(logs.copilot(spark, str(tmp_path / "o")), "session_id", "input_tokens") == [("t1", 5), ("t2", 9)]
    lines(tmp_path / "d" / "s.jsonl", [{"type": "session", "id": "D", "cwd": "/d"}, {"type": "assistant/message", "time": 1767225600000, "data": {"message": {"source": {"provider": "p", "model": "m"}}, "usage": {"inputTokens": 3, "outputTokens": 4}}}])
    assert events(logs.dsh(spark, str(tmp_path / "d")), "session_id", "model", "total_tokens") == [("D", "m", 7)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "z.settings.json").write_text(json.dumps({"providerLock": "openai", "model": "m", "providerLockTimestamp": "2026-01-01T00:00:00Z", "tokenUsage": {"inputTokens": 3, "outputTokens": 4}}))
    lines(tmp_path / "r" / "z.jsonl", [{"type": "session_start", "session_start": {"cwd": "/r"}}])
    assert events(logs.droid(spark, str(tmp_path / "r")), "session_id", "repo_root", "total_tokens") == [("z", "/r", 7)]
    lines(tmp_path / "w" / "s.jsonl", [{"type": "session", "id": "W", "provider": "p", "model": "m"}, {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "usage": {"prompt_tokens": 10, "cached": 4, "completion_tokens": 2}}, {"type": "message", "model": "delivery-mirror", "usage": {"input": 9}}])
    assert events(logs.openclaw(spark, str(tmp_path / "w")), "session_id", "input_tokens", "cache_read_tokens", "output_tokens") == [("W", 6, 4, 2)]


def test_tool_calls(spark, tmp_path):
    block = lambda s, b: {"type": "x", "timestamp": f"2026-01-01T00:00:0{s}Z", "sessionId": "s", "message": {"content": [b]}}
    lines(tmp_path / "a.jsonl", [block(1, {"type": "tool_use", "id": "c1", "name": "Read"}), block(3, {"type": "tool_result", "tool_use_id": "c1", "is_error": True}), block(4, {"type": "tool_use", "id": "c2", "name": "Bash"})])
    got = {r["call_id"]: (r["status"], r["duration_ms"]) for r in logs.claude_tool_calls(spark, str(tmp_path)).collect()}
    assert got == {"c1": ("error", 2000), "c2": ("unknown", None)}


def test_sqlite_sources(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.db")
    db.execute("create table sessions(id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens)")
    db.execute("insert into sessions values ('s', '{\"model_name\":\"m\"}', 'openai', '2026-01-01 00:00:00', 20, 10, 6)")
    db.commit()
    assert events(sqlite.goose(spark, str(tmp_path)), "session_id", "model", "output_tokens", "reasoning_tokens", "total_tokens") == [("s", "m", 10, 4, 20)]
    (tmp_path / "o").mkdir()
    db = sqlite3.connect(tmp_path / "o" / "o.db")
    db.execute("create table message(id, session_id, time_created, data)")
    db.execute("create table session_message(id, session_id, type, seq, time_created, data)")
    db.execute("create table session_v2(id, directory)")
    data = json.dumps({"role": "assistant", "modelID": "m", "tokens": {"input": 1, "output": 2, "reasoning": 1}})
    db.execute("insert into message values ('a', 's', 1767225600000, ?)", (data,))
    db.executemany("insert into session_message values (?, 's', 'assistant', 1, 1767225600000, ?)", [("a", data), ("b", data)])
    db.commit()
    assert events(sqlite.opencode(spark, str(tmp_path / "o")), "message_id", "total_tokens") == [("a", 3), ("b", 4)]
    inner = bytes([2 << 3, 7, 3 << 3, 9, 11 << 3 | 2, 2]) + b"r1"
    assert sqlite.proto_fields(inner) == [(2, 0, 7), (3, 0, 9), (11, 2, b"r1")] and sqlite.proto_fields(b"\xff\xff") == [] and sqlite.turn_of(inner) is None


def test_git_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("commit\tabc\t2026-01-01T00:00:00+01:00\tMe\n\n 2 files changed, 5 insertions(+), 1 deletion(-)\ncommit\tdef\t2026-01-02T00:00:00Z\tYou\n")
    got = [tuple(r) for r in gitlog.commits(spark, str(tmp_path)).orderBy("hash").select("hash", "added", "deleted", "files", F.col("ts").cast("string")).collect()]
    assert got == [("abc", 5, 1, 2, "2025-12-31 23:00:00"), ("def", 0, 0, 0, "2026-01-02 00:00:00")]


def test_exports_and_ledger(spark, tmp_path):
    usage = bindings.usage(spark, SF)
    sinks.write_csv(usage.limit(20).withColumn("model", F.lit("=cmd()")), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["model"] == "'=cmd()"
    sinks.write_jsonl(usage.limit(5), str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 5
    sinks.write_ledger(usage, str(tmp_path / "ledger"))
    sinks.write_ledger(usage.where("file = 'f1'").limit(1), str(tmp_path / "ledger"))
    kept = sinks.read_ledger(spark, str(tmp_path / "ledger"))
    assert kept.where("file <> 'f1'").count() == usage.where("file <> 'f1'").count() and kept.where("file = 'f1'").count() <= usage.where("file = 'f1'").count()
    sinks.write_bundle(usage, str(tmp_path / "bundle"))
    assert sinks.read_bundle(spark, str(tmp_path / "bundle"), "event_index: bigint, total_tokens: bigint").count() == usage.count()
    (tmp_path / "cutoff").mkdir()
    (tmp_path / "cutoff" / "x.txt").write_text('{"type":"file"}\n')
    with pytest.raises(ValueError):
        sinks.read_bundle(spark, str(tmp_path / "cutoff"), "event_index: bigint")
    spans = sinks.otlp_traces(usage)
    assert spans.select("traceId").distinct().count() == usage.select("source", "session_id").distinct().count()
    assert "| a\\|b |" in sinks.markdown(spark.createDataFrame([("a|b",)], "x string"))
    assert sinks.sparkline([0, 1, 4, 8], 4)[-1] == "█" and len(sinks.sparkline(list(range(100)), 10)) == 10


def test_stream_counts_once(spark, tmp_path):
    usage = bindings.usage(spark, SF).limit(200)
    usage.write.parquet(str(tmp_path / "in" / "a"))
    usage.write.parquet(str(tmp_path / "in" / "b"))
    stream = ingest.once(ingest.usage_stream(spark, str(tmp_path / "in" / "*"), USAGE), "400 days")
    q = ingest.append(stream.drop("content_hash"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == usage.select(*dedupe.IDENTITY).distinct().count()


def test_text_functions(spark):
    row = spark.range(1).select(text.provider_of_model(F.lit("O3-mini")).alias("a"), text.model_name(F.lit(" GPT-5\x07 ")).alias("b"), text.csv_guard(F.lit("plain")).alias("c"), text.ancestors(F.lit("/a/b")).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("openai", "gpt-5", "plain", ["/a/b", "/a", "/"])


def test_plans_have_no_python_and_push_filters(spark):
    from quillmeter import catalogue

    for name in ("usage_daily", "blocks_5h", "price_both", "cube_cells", "dedupe_repeated_files"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    window = catalogue.queries()["filter_instant_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in window and "LessThan(ts" in window


def test_entry_runs_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    sys.path.insert(0, "/root/repo")
    monkeypatch.setitem(sys.modules, "quillmeter.llm", None)
    monkeypatch.delitem(sys.modules, "quillmeter.llm.queries", raising=False)
    import __spark_entry__

    module = importlib.reload(__spark_entry__)
    assert "usage_daily" in module.queries() and not any(n.startswith("op") and n[2].isdigit() for n in module.queries())
    monkeypatch.undo()
    importlib.reload(module)
