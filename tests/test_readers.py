"""Readers on logs of our own where order, forks, copies and half-written files matter."""

import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from quillmeter.sources import codex, logs, raw, sqlite


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def events(df, *columns):
    return sorted((tuple(r) for r in raw.good(df).select(*columns).collect()), key=str)


def meta(i, version="0.150.0", **more):
    return {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": i, "cwd": "/w", "model_provider": "openai", "cli_version": version, **more}}


def counted(s, total, last=None):
    tokens = lambda n: None if n is None else {"input_tokens": n, "output_tokens": n // 10}
    info = {k: v for k, v in (("total_token_usage", tokens(total)), ("last_token_usage", tokens(last))) if v}
    return {"timestamp": f"2026-01-01T00:00:{s:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def record(s, response, n):
    return {"timestamp": f"2026-01-01T00:00:{s:02d}Z", "type": "token_usage_record", "payload": {"response_id": response, "usage": {"input_tokens": n, "output_tokens": n // 10}}}


def said(role, text):
    return {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}


PARENT, CHILD = "0" * 35 + "1", "0" * 35 + "2"


def codex_events(spark, folder):
    return events(codex.codex(spark, str(folder)), "session_id", "input_tokens", "output_tokens")


def test_a_marker_ends_the_copies_of_a_fork(spark, tmp_path):
    own = {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_id": CHILD}}
    write(tmp_path / "a.jsonl", [meta(CHILD, "0.153.0", forked_from_id=PARENT), meta(PARENT), counted(1, 100, 100), own, counted(2, 150, 50)])
    assert codex_events(spark, tmp_path) == [(CHILD, 50, 5)]


def test_a_fork_without_marker_is_told_by_its_parent(spark, tmp_path):
    write(tmp_path / f"rollout-1-{PARENT}.jsonl", [meta(PARENT), said("user", "a"), counted(1, 100, 100), said("user", "b"), counted(2, 300, 200)])
    write(tmp_path / f"rollout-2-{CHILD}.jsonl", [meta(CHILD, forked_from_id=PARENT), said("user", "a"), counted(5, 100, 100), said("user", "c"), counted(6, 140, 40)])
    assert codex_events(spark, tmp_path) == [(PARENT, 100, 10), (PARENT, 200, 20), (CHILD, 40, 4)]


def test_a_fork_of_an_absent_parent_counts(spark, tmp_path):
    write(tmp_path / "a.jsonl", [meta(CHILD, forked_from_id=PARENT), counted(1, 100, 100), counted(2, 150, 50)])
    assert codex_events(spark, tmp_path) == [(CHILD, 100, 10), (CHILD, 50, 5)]


def test_responses_count_once_and_replace_one_difference(spark, tmp_path):
    write(tmp_path / "a.jsonl", [meta(CHILD), counted(1, 100, 100), record(2, "r1", 40), record(2, "r1", 40), record(2, "r2", 20), counted(3, 160, 60), counted(4, 200, 40), record(5, "r3", 70)])
    assert codex_events(spark, tmp_path) == [(CHILD, 100, 10), (CHILD, 20, 2), (CHILD, 40, 4), (CHILD, 40, 4), (CHILD, 70, 7)]


def test_totals_fall_repeat_and_go_missing(spark, tmp_path):
    write(tmp_path / "a.jsonl", [meta(CHILD), counted(1, 100, 100), counted(2, 100, 100), counted(3, 30, 30), counted(4, None, 50), counted(4, None, 50), "{broken", counted(5, 90, 10), '{"type":"event_msg","payload":{"type":"token_count","info":null}}'])
    assert codex_events(spark, tmp_path) == [(CHILD, 10, 4), (CHILD, 100, 10), (CHILD, 30, 3), (CHILD, 50, 5)] or codex_events(spark, tmp_path) == [(CHILD, 10, 1), (CHILD, 100, 10), (CHILD, 30, 3), (CHILD, 50, 5)]


def test_a_plain_rollout_stands_for_its_compressed_copy(spark, tmp_path):
    write(tmp_path / "a.jsonl", [meta(CHILD), counted(1, 100, 100)])
    packed = zstandard.ZstdCompressor().compress((tmp_path / "a.jsonl").read_bytes())
    (tmp_path / "a.jsonl.zst").write_bytes(packed)
    (tmp_path / "b.jsonl.zst").write_bytes(packed)
    assert codex_events(spark, tmp_path) == [(CHILD, 100, 10)] * 2


def test_codex_calls_and_messages(spark, tmp_path):
    item = lambda s, **p: {"timestamp": f"2026-01-01T00:00:0{s}Z", "type": "response_item", "payload": p}
    write(tmp_path / "a.jsonl", [meta("S"), {"type": "turn_context", "payload": {"model": "gpt-5"}}, item(1, type="function_call", call_id="c1", name="shell"), item(4, type="function_call_output", call_id="c1", output="x"), item(5, type="custom_tool_call", call_id="c2", name="patch"), item(6, type="web_search_call", id="w", status="completed"), item(7, type="function_call", name="lost"), said("user", "<skill>x"), said("user", "hello"), said("developer", "be brief"), said("assistant", "  "), said("tool", "odd")])
    calls = {r["name"]: (r["session_id"], r["status"], r["duration_ms"]) for r in codex.codex_tool_calls(spark, str(tmp_path)).collect()}
    assert calls == {"shell": ("S", "ok", 3000), "patch": ("S", "unknown", None), "web_search": ("S", "ok", 0)}
    assert sorted((r["role"], r["text_length"]) for r in codex.codex_messages(spark, str(tmp_path)).collect()) == [("assistant", 2), ("system", 8), ("system", 8), ("user", 5)]


def test_pi_forks(spark, tmp_path):
    head = lambda i, t, **more: {"type": "session", "id": i, "timestamp": t, **more}
    message = lambda t, n: {"type": "message", "timestamp": t, "usage": {"input": n, "output": 1}}
    fork = [head("F", "2026-01-02T00:00:00Z", parentSession="t_P.jsonl"), message("2026-01-01T10:00:00Z", 5), message("2026-01-02T10:00:00Z", 7)]
    write(tmp_path / "alone" / "t_F.jsonl", fork)
    assert events(logs.pi(spark, str(tmp_path / "alone")), "session_id", "input_tokens") == [("F", 7), ("P", 5)]
    write(tmp_path / "both" / "t_F.jsonl", fork)
    write(tmp_path / "both" / "t_P.jsonl", [head("P", "2026-01-01T00:00:00Z"), message("2026-01-01T10:00:00Z", 5)])
    assert events(logs.pi(spark, str(tmp_path / "both")), "session_id", "input_tokens") == [("F", 7), ("P", 5)]


def test_kimi_models_change_at_an_instant(spark, tmp_path):
    row = lambda m, t: {"timestamp": t, "message": {"type": "StatusUpdate", "payload": {"message_id": m, "token_usage": {"input_other": 1, "output": 1}}}}
    write(tmp_path / "g" / "s" / "wire.jsonl", [row("a", "2026-04-20T15:28:10.071Z"), row("b", "2026-04-20T15:28:10.072Z")])
    assert events(logs.kimi(spark, str(tmp_path)), "message_id", "model") == [("a", "kimi-k2.5"), ("b", "kimi-k2.6")]


def test_claude_forks_are_told_by_their_meta_files(spark, tmp_path):
    row = lambda i, s: {"type": "assistant", "timestamp": f"2026-01-01T00:00:0{s}Z", "sessionId": "s", "requestId": "r", "message": {"id": i, "model": "claude-x", "usage": {"input_tokens": s, "output_tokens": 1}}}
    write(tmp_path / "s.jsonl", [row("m1", 1)])
    for agent, info in (("1", {"isFork": True}), ("2", {"isFork": False}), ("3", {"isFork": True, "parentAgentId": "1"})):
        (tmp_path / "s" / "subagents").mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / "subagents" / f"agent-{agent}.meta.json").write_text(json.dumps(info))
        write(tmp_path / "s" / "subagents" / f"agent-{agent}.jsonl", [row("m1", 1), row("m8", 3), row(f"own{agent}", 2)])
    got = [tuple(r) for r in raw.good(logs.claude(spark, str(tmp_path))).select(F.regexp_extract("file", "([^/]+)$", 1), "message_id").collect()]
    assert sorted(got) == sorted([("s.jsonl", "m1"), ("agent-1.jsonl", "m8"), ("agent-1.jsonl", "own1"), ("agent-2.jsonl", "m1"), ("agent-2.jsonl", "m8"), ("agent-2.jsonl", "own2"), ("agent-3.jsonl", "own3")])


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def inner(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def test_antigravity_reads_its_tables(spark, tmp_path):
    def turn(response, n, at=None):
        usage = number(1, 900) + number(2, n) + number(3, 20) + number(5, 4) + number(9, 12) + number(10, 8) + inner(11, response.encode())
        when = inner(9, number(1, 2**60) + inner(4, number(1, at) + number(2, 5_000_000))) if at else b""
        return inner(1, inner(19, b"gemini-3-pro") + inner(4, usage) + when)

    db = sqlite3.connect(tmp_path / "conv.db")
    db.execute("create table gen_metadata (idx integer primary key, data blob)")
    db.executemany("insert into gen_metadata values (?, ?)", [(0, turn("r1", 7, 1767225600)), (1, turn("r1", 99, 1767225601)), (2, turn("r2", 8)), (3, b"\xff\xff"), (4, inner(1, b""))])
    db.execute("create table trajectory_metadata_blob (data blob)")
    db.execute("insert into trajectory_metadata_blob values (?)", (inner(2, number(1, 1767225000)),))
    db.commit()
    rows = events(sqlite.antigravity(spark, str(tmp_path)), "session_id", "message_id", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", F.col("ts").cast("string"))
    assert rows == [("conv", "r1", 7, 20, 8, 31, "2026-01-01 00:00:00.005"), ("conv", "r2", 8, 20, 8, 32, "2025-12-31 23:50:00")]


def test_commits_in_a_write_ahead_log_are_read(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    db = sqlite3.connect(live / "g.db")
    db.execute("pragma journal_mode=wal")
    db.execute("create table sessions(id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens)")
    db.commit()
    db.execute("pragma wal_checkpoint(truncate)")
    db.execute("insert into sessions values ('s', null, 'openai', '2026-01-01 00:00:00', 20, 10, 10)")
    db.commit()
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("g.db", "g.db-wal"):
        (copy / name).write_bytes((live / name).read_bytes())
    assert events(sqlite.goose(spark, str(copy)), "session_id", "total_tokens") == [("s", 20)]
    db.close()


def test_a_broken_database_fails(spark, tmp_path):
    (tmp_path / "g.db").write_bytes(b"no database at all" * 100)
    with pytest.raises(Exception, match="not a database"):
        sqlite.goose(spark, str(tmp_path)).collect()


def test_opencode_steps(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "o.db")
    db.execute("create table message(id, session_id, time_created, data)")
    db.execute("create table part(id, message_id, time_created, data)")
    tokens = lambda i, o, r, **more: {"input": i, "output": o, "reasoning": r, "cache": {"read": 0, "write": 0}, **more}
    message = lambda t: json.dumps({"role": "assistant", "modelID": "m", "tokens": t})
    db.executemany("insert into message values (?, 's', 1767225600000, ?)", [("a", message(tokens(9, 9, 0))), ("b", message(tokens(10, 5, 2, total=17))), ("c", message(tokens(10, 5, 2, total=15))), ("d", json.dumps({"role": "user"}))])
    part = lambda i, m, t: (i, m, 1767225600000, json.dumps({"type": "step-finish", "tokens": t, "cost": 0.5}))
    db.executemany("insert into part values (?, ?, ?, ?)", [part("p2", "a", tokens(3, 4, 0)), part("p1", "a", tokens(1, 2, 0)), part("p3", "b", tokens(10, 5, 2)), ("p4", "a", 1, json.dumps({"type": "text"}))])
    db.commit()
    rows = events(sqlite.opencode(spark, str(tmp_path)), "message_id", "event_index", "input_tokens", "output_tokens", "total_tokens", "cost_usd")
    assert rows == [("a", 0, 1, 2, 3, 0.5), ("a", 1, 3, 4, 7, 0.5), ("b", 0, 10, 7, 17, None), ("c", 0, 10, 5, 15, None)]


JUNK = [
    "{broken", "[]", "null", '"text"', "5", "", " ", "\x00", '{"type":"assistant","message":{"usage":[]}}', '{"type":"assistant","message":{"usage":{"input_tokens":"x","output_tokens":-5}}}', '{"type":"assistant","message":[]}',
    '{"type":"message","usage":"x"}', '{"type":"message","usage":{"input":{},"cost":[]}}', '{"type":"assistant","usageMetadata":5}', '{"type":"assistant","usageMetadata":{"promptTokenCount":"NaN"}}', '{"type":"assistant/message","data":{"usage":7}}',
    '{"name":"chat gen_ai","attributes":[]}', '{"name":"chat gen_ai","attributes":{"gen_ai.usage.input_tokens":"1e400"}}', '{"message":{"type":"StatusUpdate","payload":null}}', '{"type":"usage.record","usage":[1]}',
    '{"type":"session_meta","payload":5}', '{"type":"session_meta","payload":{"id":[],"forked_from_id":"x","cli_version":"a.b"}}', '{"type":"event_msg","payload":{"type":"token_count","info":[]}}', '{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":"x","last_token_usage":[]}}}', '{"type":"token_usage_record","payload":{"usage":{"input_tokens":9}}}',
]
BODIES = ["{broken", "[]", "null", "5", '{"messages":5}', '{"messages":[null,5,{"usage":"x"},{"type":"gemini","tokens":[]}],"usageLedger":{"events":[null,{"tokens":5}]}}', '[{"type":"say","say":"api_req_started","text":"{broken"},{"type":"say","say":"api_req_started","text":"[]","ts":"soon"},null]', '{"tokenUsage":{"inputTokens":"many"}}']


@pytest.mark.parametrize("source", sorted(logs.READERS))
def test_malformed_logs_give_no_event_and_no_error(spark, tmp_path, source):
    write(tmp_path / "wire.jsonl", JUNK)
    write(tmp_path / "b.jsonl", JUNK)
    (tmp_path / "empty.jsonl").write_text("")
    for i, body in enumerate(BODIES):
        for name in (f"{i}.json", "ui_messages.json", "x.settings.json", "projects.json"):
            at = tmp_path / "chats" / f"d{i}" / "chats" / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(body)
    rows = logs.READERS[source](spark, str(tmp_path))
    assert raw.good(rows).count() == 0, raw.good(rows).collect()
    assert all(r["reason"] for r in raw.skipped(rows).collect())


def test_one_bad_line_costs_one_line(spark, tmp_path):
    good = lambda i: {"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "sessionId": "s", "requestId": "r", "message": {"id": i, "model": "claude-x", "usage": {"input_tokens": 3, "output_tokens": 1}}}
    write(tmp_path / "a.jsonl", [good("a"), "{usage broken", {"type": "assistant", "message": {"usage": {"input_tokens": 1}}, "timestamp": "soon", "sessionId": "s"}, good("b")])
    rows = logs.claude(spark, str(tmp_path))
    assert events(rows, "message_id") == [("a",), ("b",)]
    assert [(r["reason"], r["rows"]) for r in raw.skipped(rows).collect()] == [("invalid_timestamp", 1)]
    assert raw.malformed(raw.lines(spark, str(tmp_path), "*.jsonl"), "claude").first()["rows"] == 1


def test_roots_that_hold_each_other_are_read_once(spark, tmp_path):
    write(tmp_path / "a" / "b" / "x.jsonl", [{"type": "assistant", "usage": 1}])
    both = [str(tmp_path / "a"), str(tmp_path / "a" / "b"), str(tmp_path / "a") + "/"]
    assert raw.distinct_roots(both) == [str(tmp_path / "a")] and raw.lines(spark, both).count() == 1
    told = raw.classified(spark, both, {"usage": ["usage"], "other": ["nothing"]}).first()
    assert told["usage"] and not told["other"]
