"""Usage and session events of codex rollouts: one ordered fold a file, as running totals, forks and records depend on order."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.sources.raw import first_time, get, lines, session_of, usage_rows, word

#: Token counters as rollouts name them; in `Usage` the first is without its cached part.
COUNTERS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens"]
Usage = tuple[int, int, int, int, int]

# The model of rollouts that name none, versions that log a record per response,
# and versions whose spawned subagents copy their parent's lines without naming a fork.
NO_MODEL = "legacy-codex-unknown"
RECORDS_FROM = (0, 153)
SPAWNED_COPIES = ((0, 120), (0, 134))


def version_of(text: str | None) -> tuple[int, int]:
    parts = [int(p) if p.isdigit() else -1 for p in (text or "").split(".")[:2]]
    return (*parts, -1, -1)[:2]


@dataclass
class Rollout:
    """The state of one file; take() feeds a line, finish() the end."""

    session: str
    parent: list[str]
    provider: str = "openai"
    cwd: str | None = None
    model: str | None = None
    total: Usage | None = None
    last_only: tuple | None = None
    pending: list[tuple] = field(default_factory=list)
    responses: set[str] = field(default_factory=set)
    out: list[tuple] = field(default_factory=list)
    #: Where a copied block began in `out`, and the thread whose marker ends it.
    held_from: int | None = None
    fork: str | None = None
    records_logged: bool = False
    awaits_baseline: bool = False
    started: bool = False
    copied_until: int | None = None

    def meta(self, x: dict) -> None:
        if self.fork is not None and self.started:
            return  # an ancestor's, copied into the fork
        if not self.started:
            named = x["forked"] is not None
            spawned = x["spawned"] is not None and SPAWNED_COPIES[0] <= version_of(x["version"]) <= SPAWNED_COPIES[1]
            if named or (spawned and self.copied_until is not None):
                self.fork, self.held_from = x["id"] or "", len(self.out)
                self.records_logged = version_of(x["version"]) >= RECORDS_FROM
        self.started = True
        self.session, self.provider, self.cwd = x["id"] or self.session, x["provider"] or self.provider, x["cwd"] or self.cwd

    def end_copies(self) -> None:
        """What was held, and what a fork's copies left pending, is the parent's; the running total stays as the baseline."""
        del self.out[self.held_from :]
        self.fork = self.held_from = None
        self.pending, self.last_only = [], None
        self.awaits_baseline = self.records_logged and self.total is None

    def emit(self, x: tuple) -> None:
        self.out.append((*x, self.session, self.provider))

    def record(self, x: dict) -> None:
        if x["used"] is None or not any(x["used"]) or x["response"] in self.responses:
            return
        if x["response"]:
            self.responses.add(x["response"])
        self.pending.append((x["line"], x["ts"], x["used"], True, x["response"], self.cwd, self.model))

    def counted(self, x: dict) -> None:
        total, last, before = x["total"], x["last"], self.total
        if total is None and last is None and not x["info"]:
            return
        if self.awaits_baseline:
            self.awaits_baseline = False
            if total is not None and not self.pending:
                self.total = total
                return
        only_last = False
        if total is not None and before is not None:
            if any(a < b for a, b in zip(total, before, strict=True)):
                new = last if last is not None else total
            else:
                new = tuple(a - b for a, b in zip(total, before, strict=True))
        elif last is not None:
            new, only_last = last, True
        else:
            new = total
        if new is None or not any(new):
            self.last_only = self.last_only if only_last else None
            self.total = total or self.total
            return
        key = (x["ts"], new) if only_last else None
        if only_last and key == self.last_only:
            return
        self.last_only = key
        if self.pending:
            for p in self.pending:
                self.emit(p)
            self.pending = []
        else:
            self.emit((x["line"], x["ts"], new, last is not None and new == last, None, self.cwd, self.model))
        self.total = total if total is not None else tuple(a + b for a, b in zip(before, new, strict=True)) if before is not None else new

    def take(self, x: dict) -> None:
        if x["kind"] == "session_meta":
            self.meta(x)
        elif x["kind"] == "turn_context":
            self.model, self.cwd = x["model"] or self.model, x["cwd"] or self.cwd
        elif x["kind"] == "token_usage_record":
            self.record(x)
        elif x["event"] == "thread_settings_applied":
            if self.fork is not None and x["thread"] == self.fork:
                self.end_copies()
        elif x["event"] == "token_count":
            self.counted(x)
        if self.fork is not None and x["line"] == self.copied_until:
            self.end_copies()

    def finish(self) -> list[tuple]:
        for p in self.pending:
            self.emit(p)
        return self.out


def copied_until(lines: list[dict], parent: list[str]) -> int | None:
    """The last line with a running total that a file's top shares with a contiguous run of its parent's signatures.

    Of the parent's, only messages of the assistant may be missing in between.
    """
    places, found = None, None
    for x in lines:
        if x["signature"] is None:
            continue
        after = []
        for p in range(len(parent)) if places is None else places:
            while places is not None and p < len(parent) and parent[p] != x["signature"] and parent[p].startswith("assistant:"):
                p += 1
            if p < len(parent) and parent[p] == x["signature"]:
                after.append(p + 1)
        if not after:
            break
        places = after
        if x["event"] == "token_count":
            found = x["line"]
    return found


def _usage(at: str):
    read = lambda n: F.greatest(F.lit(0), F.floor(F.coalesce(get("j", f"{at}.{n}").try_cast("double"), F.lit(0.0)))).cast("bigint")
    prompt, cached, written, said, thought = (read(n) for n in COUNTERS)
    there = F.try_variant_get("j", at, "variant").isNotNull()
    return F.when(there, F.array(F.greatest(F.lit(0), prompt - cached), F.least(cached, prompt), written, said, thought))


COLUMNS = "file string, line bigint, kind string, event string, ts string, id string, provider string, cwd string, model string, forked string, spawned string, version string, thread string, response string, info boolean, total array<bigint>, last array<bigint>, used array<bigint>, signature string, parent array<string>"
USED = "file string, line bigint, ts string, u array<bigint>, single boolean, response string, cwd string, model string, session string, provider string"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines that say something about usage or copies, numbered from 0 in each rollout; a plain file stands for its compressed copy."""
    raw = lines(spark, path, "*.jsonl*", ["token_count", "session_meta", "turn_context", "token_usage_record", "thread_settings_applied", '"role":"user"', '"role":"assistant"', '"role": "user"', '"role": "assistant"'])
    plain = raw.select(F.concat("file", F.lit(".zst")).alias("file")).distinct()
    raw = raw.join(plain, "file", "left_anti").where("j is not null")
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("bigint") - 1)
    p = "$.payload."
    kind = get("j", "$.type")
    event = get("j", p + "type")
    role = get("j", p + "role")
    said = F.when((kind == "response_item") & (event == "message") & role.isin("user", "assistant"), F.concat(role, F.lit(":"), F.sha1(F.to_json(F.try_variant_get("j", p + "content", "variant")).cast("binary"))))
    total = _usage(p + "info.total_token_usage")
    running = F.when((kind == "event_msg") & (event == "token_count") & F.try_variant_get("j", p + "info", "variant").isNotNull(), F.concat(F.lit("total:"), F.coalesce(F.array_join(total.cast("array<string>"), ":"), F.lit(""))))
    return raw.select(
        "file", "line", kind.alias("kind"), F.when(kind == "event_msg", event).alias("event"), F.date_format(first_time("j", "$.timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        word("j", p + "id").alias("id"), word("j", p + "model_provider").alias("provider"), word("j", p + "cwd").alias("cwd"), word("j", p + "model").alias("model"),
        word("j", p + "forked_from_id").alias("forked"), word("j", p + "source.subagent.thread_spawn.parent_thread_id").alias("spawned"), word("j", p + "cli_version").alias("version"), word("j", p + "thread_id").alias("thread"),
        word("j", p + "response_id").alias("response"), F.try_variant_get("j", p + "info", "variant").isNotNull().alias("info"), total.alias("total"), _usage(p + "info.last_token_usage").alias("last"), _usage(p + "usage").alias("used"),
        F.coalesce(said, running).alias("signature"),
    )


def codex(spark: SparkSession, path: str) -> DataFrame:
    """Usage of rollouts (.jsonl or .jsonl.zst): differences of running totals, or the records of single responses.

    Totals that fall back mean that the last request counts alone; an unchanged total adds
    nothing; a line with only the last request's usage counts it, but not twice in a row. Records
    of responses replace the next difference, each response once; those left at the end count too.
    What a fork copied from its parent is the parent's: the copies end at the fork's own marker,
    or, in files without one, where its lines stop to match the parent's; without either they
    count. A file is folded in one task, different files in parallel.
    """
    rows = _rows(spark, path)
    heads = rows.where("kind = 'session_meta'").groupBy("file").agg(F.min_by(F.struct(F.coalesce("forked", "spawned").alias("parent"), "version"), "line").alias("m"))
    heads = heads.where("m.parent is not null").select("file", F.col("m.parent").alias("thread"))
    thread = F.regexp_extract("file", r"-([0-9a-f-]{36})\.jsonl(?:\.zst)?$", 1)
    told = rows.where("signature is not null").withColumn("thread", thread).join(heads.select("thread").distinct(), "thread", "left_semi")
    parents = told.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "signature"))), lambda x: x["signature"]).alias("parent"))
    above = heads.join(parents, "thread").select("file", "parent").dropDuplicates(["file"])
    marks = above.select(*[F.col(n) if n in ("file", "parent") else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in COLUMNS.split(", ")) if n != "line"], F.lit(-1).cast("bigint").alias("line"))
    whole = rows.withColumn("parent", F.lit(None).cast("array<string>")).unionByName(marks)
    names = [c.split(" ")[0] for c in USED.split(", ")]

    def fold(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda x: x["line"])
        parent = []
        if found[0]["line"] < 0:
            parent = found.pop(0)["parent"] or []
        file = table.column("file")[0].as_py()
        for x in found:
            for c in ("total", "last", "used"):
                x[c] = None if x[c] is None else tuple(x[c])
        state = Rollout("", parent, copied_until=copied_until(found, parent) if parent else None)
        for x in found:
            state.take(x)
        made = [(file, line, ts, list(u), single, response, cwd, model, session or None, provider) for line, ts, u, single, response, cwd, model, session, provider in state.finish()]
        columns = list(zip(*made, strict=True)) or [()] * len(names)
        types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_(), *[pa.string()] * 5]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    used = whole.groupBy("file").applyInArrow(fold, USED)
    n = lambda i: F.element_at("u", i + 1)
    total = n(0) + n(1) + n(2) + n(3)
    return usage_rows(used, "codex", session_id=F.coalesce("session", session_of(F.col("file"))), ts=F.to_timestamp_ntz("ts"), repo_root=F.col("cwd"), provider=F.col("provider"), model=F.coalesce("model", F.lit(NO_MODEL)), input_tokens=n(0), output_tokens=n(3), reasoning_tokens=n(4), cache_read_tokens=n(1), cache_write_tokens=n(2), total_tokens=total, single_request=F.when(F.col("single"), True), message_id=F.col("response"), event_index=F.col("line"))


# Items of a response that are calls of tools, and those that answer them; how
# messages begin that were not typed by the person they are attributed to.
CALLS = ["function_call", "custom_tool_call"]
RESULTS = ["function_call_output", "custom_tool_call_output"]
INJECTED = ["<environment_context>", "<user_instructions>", "# AGENTS.md instructions", "<skill>", "<turn_aborted>", "<user_action>", "<user_shell_command>"]


def _items(spark: SparkSession, path: str) -> DataFrame:
    raw = lines(spark, path, "*.jsonl*", ["response_item", "session_meta", "turn_context"])
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("bigint") - 1)
    kind, so_far = get("j", "$.type"), Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    session = F.first(F.when(kind == "session_meta", word("j", "$.payload.id")), ignorenulls=True).over(so_far)
    model = F.last(F.when(kind == "turn_context", word("j", "$.payload.model")), ignorenulls=True).over(so_far)
    return raw.withColumns({"session_id": F.coalesce(session, session_of(F.col("file"))), "model": model, "type": get("j", "$.payload.type"), "ts": first_time("j", "$.timestamp")})


def codex_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """(source, session_id, ts, call_id, name, status, completed_at, duration_ms, file, event_index) of calls and their answers.

    An answer means that the call ran; a web search is its own answer.
    """
    from quillmeter.operators.joins import pair_calls

    rows = _items(spark, path).where(get("j", "$.type") == "response_item")
    own = [F.lit("codex").alias("source"), "session_id", "ts"]
    calls = rows.where(F.col("type").isin(CALLS)).select(*own, word("j", "$.payload.call_id").alias("call_id"), word("j", "$.payload.name").alias("name"), "file", "line")
    results = rows.where(F.col("type").isin(RESULTS)).select("file", "line", word("j", "$.payload.call_id").alias("call_id"), "ts", F.lit(False).alias("is_error"))
    paired = pair_calls(calls.where("name is not null and call_id is not null"), results)
    status = get("j", "$.payload.status")
    status = F.when(status == "completed", "ok").when(status == "failed", "error").otherwise("unknown")
    known = F.when(status != "unknown", F.col("ts"))
    searches = rows.where(F.col("type") == "web_search_call").select(*own, word("j", "$.payload.id").alias("call_id"), F.lit("web_search").alias("name"), "file", "line", known.alias("completed_at"), status.alias("status"), F.when(known.isNotNull(), F.lit(0)).cast("bigint").alias("duration_ms"))
    return paired.unionByName(searches).withColumnRenamed("line", "event_index")


def codex_messages(spark: SparkSession, path: str) -> DataFrame:
    """(source, session_id, ts, role, message_id, model, text_length, file, event_index).

    Developers' messages are the system's, and so are users' of which each block was injected.
    Blocks are joined by a blank line as they are; a message without a text block is none.
    """
    rows = _items(spark, path).where((get("j", "$.type") == "response_item") & (F.col("type") == "message"))
    blocks = F.coalesce(F.try_variant_get("j", "$.payload.content", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda b: F.try_variant_get(b, "$.type", "string")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: kind(b).isin("input_text", "output_text")), lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    text = F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))

    def injected(t):
        found = F.lit(False)
        for start in INJECTED:
            found = found | F.ltrim(t).startswith(start)
        return found

    said = get("j", "$.payload.role")
    role = F.when((said == "developer") | ((said == "user") & (F.size(texts) > 0) & F.forall(texts, injected)), "system").otherwise(said)
    out = rows.select(F.lit("codex").alias("source"), "session_id", "ts", role.alias("role"), word("j", "$.payload.id").alias("message_id"), F.when(role == "assistant", F.col("model")).alias("model"), F.char_length(text).cast("bigint").alias("text_length"), "file", F.col("line").alias("event_index"))
    return out.where("role in ('user', 'assistant', 'system') and text_length is not null")
