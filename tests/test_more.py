"""Ledger, bundles, resumed reads, session events, windows of dates, text for people, and plans of reports."""

import datetime
import http.server
import json
import threading
from typing import ClassVar

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmeter import catalogue
from quillmeter.functions import format, ranges, text
from quillmeter.operators import filters, notes, reports, share
from quillmeter.plans import bindings
from quillmeter.pricing import cost, rates, resolve
from quillmeter.sources import sessions, sinks
from quillmeter.streaming import ingest, resume

SF = "/root/testdata/sf0.001"


# ledger


def test_a_file_that_comes_in_parts_stays_whole(spark, tmp_path):
    usage = bindings.usage(spark, SF).where("file in ('f1', 'f2')")
    first, second = usage.where("event_index % 2 = 0"), usage.where("event_index % 2 = 1")
    ledger = str(tmp_path / "ledger")
    sinks.upsert_ledger(first, ledger)
    sinks.upsert_ledger(second.where("file = 'f1'"), ledger)
    kept = sinks.read_ledger(spark, ledger)
    assert kept.where("file = 'f1'").count() == usage.where("file = 'f1'").count() and kept.where("file = 'f2'").count() == first.where("file = 'f2'").count()
    sinks.upsert_ledger(second.where("file = 'f1'").withColumn("total_tokens", F.lit(7).cast("bigint")), ledger)
    again = sinks.read_ledger(spark, ledger).where("file = 'f1'")
    assert again.count() == usage.where("file = 'f1'").count() and again.where("total_tokens = 7").count() >= second.where("file = 'f1'").count()
    assert sinks.read_ledger(spark, ledger, "2024-01-05 00:00:00", "2024-01-06 00:00:00").agg(F.min("ts"), F.max("ts")).first()[0] >= datetime.datetime(2024, 1, 5)


def test_streamed_batches_add_up(spark, tmp_path):
    usage = bindings.usage(spark, SF)
    usage.where("event_index % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    usage.where("event_index % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = ingest.usage_stream(spark, str(tmp_path / "in" / "*"), usage.schema, files_per_batch=1)
    ingest.to_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    assert sinks.read_ledger(spark, str(tmp_path / "ledger")).count() == usage.count()


def test_revisions_tell_files_apart_in_any_order(spark):
    usage = bindings.usage(spark, SF)
    one = {tuple(r[:2]): r[2] for r in sinks.snapshots(usage).collect()}
    assert one == {tuple(r[:2]): r[2] for r in sinks.snapshots(usage.orderBy(F.rand(1)).repartition(7)).collect()}
    assert len(set(one.values())) == len(one)
    less = {tuple(r[:2]): r[2] for r in sinks.snapshots(usage.where("event_index <> 3")).collect()}
    assert sum(less.get(k) != v for k, v in one.items()) == 1


def test_bundles_state_what_they_hold(spark, tmp_path):
    usage = bindings.usage(spark, SF)
    path = tmp_path / "bundle"
    sinks.write_bundle(usage, str(path))
    schema = "event_index: bigint, total_tokens: bigint"
    assert sinks.read_bundle(spark, str(path), schema).count() == usage.count()
    lines = [x for f in path.glob("*.txt") for x in f.read_text().splitlines()]
    for drop in ("event", "file", "end"):
        cut = tmp_path / drop
        cut.mkdir()
        gone = next(x for x in lines if json.loads(x)["type"] == drop)
        (cut / "a.txt").write_text("\n".join(x for x in lines if x is not gone) + "\n")
        with pytest.raises(ValueError, match="incomplete"):
            sinks.read_bundle(spark, str(cut), schema)
    known = sinks.snapshots(usage.where("file <> 'f1'"))
    sinks.write_bundle(usage, str(tmp_path / "less"), known)
    left = sinks.read_bundle(spark, str(tmp_path / "less"), schema)
    assert {r["file"] for r in left.select("file").distinct().collect()} == {"f1"}


def test_a_machines_cache_is_replaced_by_file(spark, tmp_path):
    usage = bindings.usage(spark, SF).where("file in ('f1', 'f2')")
    cache = str(tmp_path / "cache")
    sinks.apply_bundle(usage, cache, "box1")
    sinks.apply_bundle(usage, cache, "box2")
    sinks.apply_bundle(usage.where("file = 'f1'").limit(1), cache, "box1")
    held = {(r["machine"], r["file"]): r["count"] for r in sinks.read_cache(spark, cache).groupBy("machine", "file").count().collect()}
    n = {r["file"]: r["count"] for r in usage.groupBy("file").count().collect()}
    assert held[("box2", "f1")] == n["f1"] and held[("box1", "f2")] == n["f2"] and held[("box1", "f1")] < n["f1"]
    assert sinks.read_cache(spark, cache, ["box2"]).select("machine").distinct().count() == 1
    files = usage.select("source", "file").distinct()
    assert sinks.live_files(usage, files.where("file = 'f1'")).where("live").select("file").distinct().count() == 1
    assert sinks.prune(usage, files.where("file = 'f1'")).select("file").distinct().count() == 1


def test_telemetry_rows_are_spans(spark, tmp_path):
    usage = bindings.usage(spark, SF)
    assert sinks.otlp_traces(usage).count() == usage.count() and sinks.otlp_traces(usage).select("span.spanId").distinct().count() == usage.count()
    with pytest.raises(ValueError):
        sinks.markdown(usage, most=10)
    assert json.loads(sinks.envelope(usage.limit(2), "x"))["report"] == "x"


class Receiver(http.server.BaseHTTPRequestHandler):
    got: ClassVar[list] = []
    answers: ClassVar[list] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        code = self.answers.pop(0) if self.answers else 200
        if code == 200:
            self.got.extend(body)
        self.send_response(code)
        self.end_headers()

    def log_message(self, *_):
        pass


def test_telemetry_is_pushed_in_batches(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    spans = sinks.otlp_traces(bindings.usage(spark, SF).limit(25)).coalesce(1)
    Receiver.answers[:] = [503, 429]
    assert sinks.push_otlp(spans, url, batch=10, wait=0.01) == 25 and len({x["span"]["spanId"] for x in Receiver.got}) == 25
    Receiver.answers[:] = [400]
    with pytest.raises(Exception, match="400"):
        sinks.push_otlp(spans, url, wait=0.01)
    server.shutdown()


def test_a_page_holds_its_data_safely(spark):
    cells = share.cube(bindings.usage(spark, SF)).limit(3).withColumn("project", F.lit("</script><b>"))
    page = sinks.share_page(cells, "<Usage>")
    assert "</script><b>" not in page and "&lt;Usage&gt;" in page and page.count("</script>") == 1
    data = page.split("const cells=")[1].split(";const by")[0]
    assert len(json.loads(data)) == 3


# resumed reads


def test_reading_goes_on_where_it_stopped(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    log.parent.mkdir()
    log.write_bytes(b'{"id":"1"}\n{"id":"2"}\n{"id":')
    none = spark.createDataFrame([], resume.CURSOR)
    key = F.get_json_object("value", "$.id")
    first = resume.read_on(spark, str(log.parent), none, "x@1")
    assert [(r["line"], r["value"], r["restarted"]) for r in first.orderBy("line").collect()] == [(0, '{"id":"1"}', True), (1, '{"id":"2"}', True)]
    cursors = spark.createDataFrame(resume.next_cursors(first, "x@1", key).collect(), resume.CURSOR)
    assert cursors.first()["rows"] == 2 and cursors.first()["offset"] == 22
    nothing = resume.read_on(spark, str(log.parent), cursors, "x@1").collect()
    assert [(r["value"], r["restarted"], r["offset"]) for r in nothing] == [(None, False, 22)]
    log.write_bytes(b'{"id":"1"}\n{"id":"2"}\n{"id":"3"}\n{"id":"1"}\n')
    more = resume.read_on(spark, str(log.parent), cursors, "x@1")
    assert [(r["line"], r["value"], r["restarted"]) for r in more.orderBy("line").collect()] == [(2, '{"id":"3"}', False), (3, '{"id":"1"}', False)]
    assert resume.conflicts(more, cursors, key).count() == 1 and resume.conflicts(more.where("line = 2"), cursors, key).count() == 0
    after = resume.next_cursors(more, "x@1", key, cursors).first()
    assert after["rows"] == 4 and len(after["ids"]) == 3
    assert {r["restarted"] for r in resume.read_on(spark, str(log.parent), cursors, "x@2").collect()} == {True}
    log.write_bytes(b'{"id":"9"}\n{"id":"2"}\n{"id":"3"}\n')
    assert [r["restarted"] for r in resume.read_on(spark, str(log.parent), cursors, "x@1").collect()] == [True] * 3


def test_rows_are_appended_once(spark):
    stored = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "file string, event_index long")
    fresh = spark.createDataFrame([("a", 5), ("a", 6), ("b", 9), ("c", 4)], "file string, event_index long")
    cursor = lambda rows: spark.createDataFrame([(f, "p", o, "h", 0, []) for f, o in rows], resume.CURSOR)
    out = resume.append_rows(stored, fresh, cursor([("a", 10), ("b", 10)]), cursor([("a", 10), ("b", 20)]))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2), ("a", 3), ("c", 0)]


def test_stages_and_files_that_fail(spark):
    doubled = resume.pipe(spark.range(3), lambda df: df.where("id > 0"), lambda df: df.unionByName(df))
    assert doubled.count() == 4
    rows, failed = resume.collect_files(spark, [f"{SF}/nation.parquet", "/no/such/file"], lambda s, p: s.read.parquet(p))
    assert list(rows) == [f"{SF}/nation.parquet"] and list(failed) == ["/no/such/file"]
    with pytest.raises(ValueError):
        resume.read_events(spark, "x", {"usage": None}, ["message"])


# session events


def test_claude_messages_and_facts(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s", "cwd": "/p", "version": "1", "message": {"content": "hello"}},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:02Z", "sessionId": "s", "cwd": "/p", "version": "2", "message": {"id": "m", "model": "claude-x", "content": [{"type": "text", "text": "a"}, {"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}]}},
        {"type": "user", "sessionId": "s", "isMeta": True, "message": {"content": [{"type": "text", "text": "meta"}]}},
        {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "content": "x"}]}},
        {"type": "summary", "sessionId": "s", "summary": "made"},
        {"type": "custom-title", "sessionId": "s", "customTitle": "given"},
        {"type": "summary", "sessionId": "s", "summary": "made later"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    said = sessions.claude_messages(spark, str(tmp_path), text=True).orderBy("event_index").collect()
    assert [(r["role"], r["text"], r["text_length"], r["model"], str(r["ts"])) for r in said] == [("user", "hello", 5, None, "2026-01-01 00:00:02"), ("assistant", "a\n\nb", 4, "claude-x", "2026-01-01 00:00:02"), ("system", "meta", 4, None, "2026-01-01 00:00:02")]
    facts = [(r["cwd"], r["agent_version"], r["model"], r["title"]) for r in sessions.claude_facts(spark, str(tmp_path)).orderBy("event_index").collect()]
    assert facts == [("/p", "1", None, None), (None, "2", "claude-x", None), (None, None, None, "made"), (None, None, None, "given")]


def test_sessions_are_gathered_within_a_bound(spark):
    calls = bindings.tool_calls(spark, SF)
    events = sessions.session_events(calls=calls)
    one = sessions.by_session(events)
    assert one.agg(F.sum("n")).first()[0] == calls.count() and one.where("size(events) <> n").count() == 0
    with pytest.raises(ValueError):
        sessions.by_session(events, most=1)


def test_live_events_prefer_what_is_stored(spark):
    event = "source string, session_id string, kind string, ts timestamp_ntz, event_index long, machine string, file string, body string"
    t = datetime.datetime(2024, 1, 1)
    row = lambda f, i, m=None, b="{}": ("s", "x", "message", t, i, m, f, b)
    stored, read, far = (spark.createDataFrame(x, event) for x in ([row("a", 0)], [row("a", 1), row("b", 2, b='{"x":1}')], [row("z", 9, "box"), row("z", 8, "box", '{"y":1}')]))
    out = reports.live_session_events(stored, read, far, ["message"], "2024-01-01", "2024-01-01")
    assert sorted(r["event_index"] for r in out.collect()) == [0, 2, 8]


# windows of dates


def test_windows_of_dates():
    assert ranges.periods_since("week", "2024-01-17", 2) == "2024-01-08" and ranges.periods_since("month", "2024-01-31", 13) == "2023-01-01" and ranges.periods_since("hour", "2024-03-01", 2) == "2024-02-29"
    assert ranges.report_window("day", "2024-01-31", last="7") == ("2024-01-25", "2024-01-31") and ranges.report_window("day", "2024-01-31", everything=True) == (None, None) and ranges.report_window("day", "2024-01-31") == ("2024-01-02", "2024-01-31")
    for bad in ({"last": "0"}, {"last": 3, "since": "2024-01-01"}, {"since": "2024-02-01", "until": "2024-01-01"}):
        with pytest.raises(ValueError):
            ranges.report_window("day", "2024-01-31", **bad)
    assert ranges.compare_windows("2024-03-31") == (("2024-03-01", "2024-03-31"), ("2024-02-01", "2024-02-29"))
    assert ranges.compare_windows("2024-03-31", "2024-03-10", "2024-03-12") == (("2024-03-10", "2024-03-12"), ("2024-03-07", "2024-03-09"))
    assert ranges.activity_start("2024-01-17") == "2023-01-16" and ranges.trend_range("2024-01-31", "2023-05-05", everything=True) == ("2023-05-05", "2024-01-31") and ranges.trend_range("2024-01-31", None, since="2024-02-05") == ("2024-02-05", "2024-02-05")
    assert ranges.git_window("2024-01-01", None) == ("2023-12-31T00:00:00Z", None) and ranges.month_end("2024-02-05") == "2024-02-29"
    assert ranges.repo_value("./x", "/w") == ("path", "/w/x") and ranges.repo_value("~/y", home="/h") == ("path", "/h/y") and ranges.repo_value("C:\\a\\") == ("path", "C:/a") and ranges.repo_value("core/x/") == ("suffix", "core/x")


# text for people


def test_labels_are_the_shortest_that_tell_apart():
    assert format.project_labels(["/a/x", "/b/x", "/c/y", None]) == {None: "(unattributed)", "/c/y": "y", "/a/x": "a/x", "/b/x": "b/x"}
    assert format.project_labels(["/x", "x", "C:\\x"]) == {"/x": "/x", "x": "x", "C:\\x": "C:\\x"}
    assert format.project_labels(["(unattributed)", None]) == {None: "(unattributed)", "(unattributed)": "./(unattributed)"}


def test_words_for_people(spark):
    assert format.closest("dialy", ["daily", "weekly"]) == "daily" and format.closest("xyz", ["daily"]) is None
    assert format.truncate_middle("abcdefghij", 5) == "ab…ij" and format.truncate_middle("ab", 5) == "ab" and format.truncate_middle("abc", 1) == "…" and format.truncate_middle("日本語日本語", 5) == "日…語"
    assert format.terminal_line("a\x1b[31mb\x07\n c") == "ab c" and format.fnv1a("") == 0x811C9DC5 and format.fnv1a("a") == 0xE40C292C
    table = sinks.terminal_table(spark.createDataFrame([("a" * 60, 1234, 0.5)], "name string, n long, usd double"), 40)
    assert all(len(x) <= 40 for x in table.splitlines()) and "1,234" in table and "…" in table
    grid = sinks.heatmap(spark.createDataFrame([("2024-01-16", 4), ("2024-01-15", 1)], "day string, level int"), "2024-01-17").split("\n")
    assert len(grid) == 7 and {len(x) for x in grid} == {53} and grid[0][-1] == "░" and grid[1][-1] == "█" and grid[3][-1] == "·"


# checks of what is asked for


def test_what_reports_refuse(spark):
    usage = bindings.usage(spark, SF)
    with pytest.raises(ValueError, match="several providers"):
        notes.optimize_provider(usage, ["unknown-model"])
    assert notes.optimize_provider(usage, ["gpt-5-codex"]) == ("openai", True) and notes.optimize_provider(usage, [], "goog") == ("google", False)
    rows = usage.select("source", "session_id").distinct()
    with pytest.raises(ValueError, match="no single session"):
        notes.one_session(rows, ["u1"])
    assert notes.one_session(rows.where("source = 'click'"), ["U8"]).first()["session_id"] == "u8"
    assert notes.need_prices(usage) and not notes.need_prices(usage, "explicit") and not notes.need_prices(usage, show_cost=False)
    with pytest.raises(ValueError, match="did you mean codex"):
        notes.known_names(["codx"], ["claude", "codex"], "source")
    assert notes.intersect_providers(None, ["a"]) == ["a"] and notes.intersect_providers(["a", "b"], ["b"]) == ["b"]
    plans = spark.createDataFrame([("p", ["click"], 20.0, 1), ("q", ["view"], 30.0, 2)], "plan string, sources array<string>, monthly_usd double, nth int")
    assert reports.selected_plans(plans, sources=["view"]).first()["plan"] == "q" and reports.selected_plans(plans, ["p"], 5).first()["monthly_usd"] == 5.0
    with pytest.raises(ValueError):
        reports.selected_plans(plans, ["p", "q"], 5)
    assert share.paginate(spark.range(10).orderBy("id"), 99, 4)[1:] == (2, 3, 10)
    assert share.omitted_count(spark.createDataFrame([("a", 2), ("b", 3)], "project string, count long"), "b").first()[0] == 3
    cells, start = share.payload(usage, "2024-06-30", 10)
    assert start == "2024-04-01" and cells.where("char_length(period) > 10").count() == 0 and share.payload(usage, "2024-06-30", 10**9)[1] is None
    assert share.period_axis(cells, "2024-03-30", "2024-04-02", "hour", start).count() == 48


# model names


def test_names_resolve_by_the_listed_rules(spark):
    keys = ["claude-sonnet-4-5", "gpt-5.4", "gpt-5.3-codex", "o3", "moonshot/kimi-k2", "vertex_ai/gemini-3-pro", "gemini/gemini-3-pro", "anthropic.claude-opus-4-1", "gpt-5-mini"]
    table = rates.example_rates(spark).limit(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("model_key"), *[c for c in rates.example_rates(spark).columns if c != "model_key"]).withColumn("provider", F.lit(None).cast("string"))
    want = {
        "claude-sonnet-4-5-20250929": "claude-sonnet-4-5", "claude-sonnet-4-5-thinking": "claude-sonnet-4-5", "claude-sonnet-4-5@20250929": "claude-sonnet-4-5", "anthropic/claude-sonnet-4-5-20250929-v1:0": "claude-sonnet-4-5",
        "claude-sonnet-4-5-v1": None, "gpt-5.4-high": "gpt-5.4", "openai/gpt-5.4-xhigh": "gpt-5.4", "gpt-5.4-2026-01-31-low": "gpt-5.4", "gpt-5.4-pro-max-plus": None, "gpt-5.3-codex:latest": "gpt-5.3-codex",
        "o3-0613": "o3", "o3-pro-deep": None, "kimi-k2": "moonshot/kimi-k2", "kimi-k2-thinking": None, "gemini-3-pro": "gemini/gemini-3-pro", "claude-opus-4-1": "anthropic.claude-opus-4-1", "gpt5-minii": "gpt-5-mini", "gpt-6-minii": None,
    }
    names = spark.createDataFrame([(m,) for m in want], "model string")
    got = {r["model"]: r["model_key"] for r in resolve.resolve_models(names, table).collect()}
    assert got == want
    never = {r["model"]: r["model_key"] for r in resolve.resolve_models(names, table, never_fuzzy=("gpt5-minii",)).collect()}
    assert never["gpt5-minii"] is None


# plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_reach_the_scan(spark):
    usage = bindings.usage(spark, SF)
    for df in (reports.window_summary(usage, "2024-01-05", "2024-01-06"), reports.compare(usage, ("2024-01-05", "2024-01-06"), ("2024-01-03", "2024-01-04")), reports.wrapped_top(usage, 2024, "model"), reports.wrapped_months(usage, 2024), reports.summary(usage, "2024-01-20 00:00:00")):
        assert "GreaterThanOrEqual(ts" in plan(df) and "LessThan(ts" in plan(df)
    paris = filters.local_window(usage, "2024-01-05", "2024-01-06", "Europe/Paris")
    assert "GreaterThanOrEqual(ts,2024-01-04T23:00)" in plan(paris)


def test_merging_reads_each_side_a_bounded_number_of_times(spark):
    logical = catalogue.queries()["machine_merge"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Relation [") <= 8


def test_deep_paths_have_all_their_ancestors(spark):
    deep = "/" + "/".join(f"d{i}" for i in range(60))
    row = spark.range(1).select(F.size(text.ancestors(F.lit(deep))).alias("n"), text.moved_below(F.lit("C:\\a\\b\\c"), F.lit("C:\\a"), F.lit("/x")).alias("m"), text.moved_below(F.lit("/a/b"), F.lit("/a"), F.lit("D:\\y")).alias("w")).first()
    assert (row["n"], row["m"], row["w"]) == (61, "/x/b/c", "D:\\y\\b")


# notes


def test_zeros_are_counted_as_their_sql_says(spark, tmp_path):
    events = [(350, 1, "click", 5.0, 0), (700, 1, "view", 5.0, 0), (1400, 1, "click", 5.0, 3), (49, None, "click", 5.0, 2), (70, 2, None, 5.0, 5), (77, 2, "click", 5.0, -5), (91, 2, "view", 5.0, 4), (98, 2, "view", None, 2), (112, 2, "view", 5.0, 1), (119, 2, "view", 5.0, None)]
    db = duckdb.connect()
    db.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    db.executemany("insert into events values (?, timestamp '2024-01-05', ?, ?, ?, ?)", [(*e[:4], None if e[4] is None else json.dumps({"k": e[4]})) for e in events])
    db.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    ours = {tuple(r) for r in catalogue.queries()["reestimated_zero"](spark, str(tmp_path)).select("source", "events").collect()}
    assert ours == set(db.execute(catalogue.oracle_sql()["reestimated_zero"]).fetchall()) == {("click", 4), ("view", 1), (None, 1)}


def test_zeros_without_tokens_stay_zeros(spark):
    usage = bindings.usage(spark, SF).where("model = 'claude-sonnet-4-5'").limit(1).withColumn("cost_usd", F.lit(0.0))
    bare = usage.withColumns({c: F.lit(0).cast("bigint") for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "total_tokens")})
    rows = bare.withColumn("event_index", F.lit(-1).cast("bigint")).unionByName(usage.withColumns({"file": F.lit(None).cast("string"), "input_tokens": F.lit(5).cast("bigint"), "total_tokens": F.lit(5).cast("bigint")}))
    assert [r["events"] for r in notes.reestimated_zero(rows, cost.priced(rows, rates.example_rates(spark))).collect()] == [1]
