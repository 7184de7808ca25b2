"""Session events beside usage: messages, tool calls and facts about sessions, in one shape for all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions.text import blank_to_null
from quillmeter.sources.raw import first_time, get, lines, session_of, word

FACTS = ["cwd", "title", "git_branch", "agent_version", "parent_session_id", "model", "raw_provider"]
ROLES, STATES = ("user", "assistant", "system"), ("ok", "error", "unknown")


def joined_text(content: Column, kinds: list[str]) -> Column:
    """The text of a message: itself, or its blocks of the kinds given joined by a blank line; null without any."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(kinds)), lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    # a variant that is no array is the text itself
    return F.when(blocks.isNotNull(), F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))).otherwise(F.try_variant_get(content, "$", "string"))


def carried_time(rows: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """rows with ts filled: the last valid time before in the file, or the first one after where there is none before."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("ts", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("ts", F.coalesce(before, after))


def changed_facts(stated: DataFrame, keys: list[str] | None = None, order: str = "line") -> DataFrame:
    """Rows of stated(keys, line, facts, [ai_title]) that say something new of a session, with the changed facts alone.

    Blank facts state nothing. A title of the tool's own making counts until a title was given.
    """
    keys = keys or ["file", "session_id"]
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = stated.withColumns({f: blank_to_null(F.col(f)) if f in stated.columns else F.lit(None).cast("string") for f in FACTS})
    made = F.coalesce("ai_title", F.lit(False)) if "ai_title" in stated.columns else F.lit(False)
    given = F.coalesce(F.max(F.col("title").isNotNull() & ~made).over(so_far), F.lit(False))
    rows = rows.withColumn("_given", given).withColumn("title", F.when(~(made & F.col("_given")), F.col("title")))
    was = rows.withColumns({f"_was_{f}": F.last(f, ignorenulls=True).over(so_far) for f in FACTS})
    out = was.withColumns({f: F.when(~F.col(f).eqNullSafe(F.col(f"_was_{f}")), F.col(f)) for f in FACTS})
    some = F.coalesce(*[F.col(f) for f in FACTS])
    return out.where(some.isNotNull()).drop("_given", *[f"_was_{f}" for f in FACTS])


def session_events(messages: DataFrame | None = None, calls: DataFrame | None = None, facts: DataFrame | None = None, usage: DataFrame | None = None, raw_provider: str = "provider") -> DataFrame:
    """All kinds in one frame: (source, session_id, kind, ts, file, event_index, body, reject).

    body is the event as JSON. reject says why a row is no event: no session, no time, a role, a
    name or a state that isn't one. Usage keeps the provider as it was logged.
    """
    parts = []
    base = ["source", "session_id", "ts", "file", F.col("event_index").cast("bigint").alias("event_index")]
    bad = F.when(F.col("session_id").isNull(), "missing_session_id").when(F.col("ts").isNull(), "invalid_timestamp")

    def part(df: DataFrame, kind: str, body: list, more: Column | None = None) -> None:
        reject = bad if more is None else F.coalesce(bad, more)
        parts.append(df.select(*base, F.lit(kind).alias("kind"), F.to_json(F.struct(*body)).alias("body"), reject.alias("reject")))

    if messages is not None:
        own = [c for c in ("role", "message_id", "model", "text_length", "text") if c in messages.columns]
        part(messages, "message", own, F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown_role"))
    if calls is not None:
        own = [c for c in ("call_id", "name", "status", "completed_at", "duration_ms", "message_id") if c in calls.columns]
        part(calls, "tool_call", own, F.when(blank_to_null(F.col("name")).isNull(), "missing_name").when(~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "unknown_status"))
    if facts is not None:
        part(facts, "session_meta", [c for c in FACTS if c in facts.columns], F.when(F.coalesce(*[F.col(c) for c in FACTS if c in facts.columns]).isNull(), "no_facts"))
    if usage is not None:
        own = [c for c in usage.columns if c not in ("source", "session_id", "ts", "file", "event_index", "machine", "reject")]
        part(usage, "usage", [*own, F.col(raw_provider).alias("raw_provider")])
    if not parts:
        raise ValueError("no kind of event given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "session_id", "kind", "ts", "file", "event_index", "body", "reject")


def by_session(events: DataFrame, most: int = 100_000) -> DataFrame:
    """(source, session_id, first_ts, n, events): sessions in the order of their first event, with the events of each in order.

    A session of more than `most` events is refused: it is read by filtering, not gathered.
    """
    sizes = events.groupBy("source", "session_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).limit(1).collect()
    if large:
        raise ValueError(f"session {large[0]['session_id']} has {large[0]['n']} events; filter it instead")
    one = F.array_sort(F.collect_list(F.struct("ts", "event_index", "kind", "body")))
    return events.groupBy("source", "session_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), one.alias("events"))


def claude_messages(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """Messages of users and assistants; a line without time takes one from its neighbours. Sidechains and tool results aren't messages."""
    raw = lines(spark, path, "*.jsonl", ['"user"', '"assistant"'])
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("bigint") - 1)
    rows = carried_time(raw.withColumn("ts", first_time("j", "$.timestamp")), ["file"])
    kind = get("j", "$.type")
    said = joined_text(F.try_variant_get("j", "$.message.content", "variant"), ["text"])
    system = F.coalesce(F.try_variant_get("j", "$.isMeta", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get("j", "$.isCompactSummary", "boolean"), F.lit(False))
    role = F.when((kind == "user") & system, "system").otherwise(kind)
    out = rows.where(kind.isin("user", "assistant")).select(F.lit("claude").alias("source"), F.coalesce(word("j", "$.sessionId"), session_of(F.col("file"))).alias("session_id"), "ts", role.alias("role"), word("j", "$.message.id", "$.uuid").alias("message_id"), F.when(kind == "assistant", word("j", "$.message.model")).alias("model"), F.char_length(said).cast("bigint").alias("text_length"), *([said.alias("text")] if text else []), "file", F.col("line").alias("event_index"))
    return out.where("text_length > 0")


def claude_facts(spark: SparkSession, path: str) -> DataFrame:
    """What changes about sessions: folder, branch, version, model, titles given or made."""
    raw = lines(spark, path, "*.jsonl")
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("bigint") - 1)
    kind = get("j", "$.type")
    own = F.when(kind == "custom-title", word("j", "$.customTitle", "$.title"))
    made = F.when(kind.isin("ai-title", "summary"), word("j", "$.aiTitle", "$.summary", "$.title"))
    rows = raw.where("j is not null").select("file", "line", F.lit("claude").alias("source"), F.coalesce(word("j", "$.sessionId"), session_of(F.col("file"))).alias("session_id"), first_time("j", "$.timestamp").alias("ts"), word("j", "$.cwd").alias("cwd"), F.coalesce(own, made).alias("title"), made.isNotNull().alias("ai_title"), word("j", "$.gitBranch").alias("git_branch"), word("j", "$.version").alias("agent_version"), F.when(kind == "assistant", F.nullif(word("j", "$.message.model"), F.lit("<synthetic>"))).alias("model"))
    return changed_facts(carried_time(rows, ["file"])).withColumnRenamed("line", "event_index")


def codex_facts(spark: SparkSession, path: str) -> DataFrame:
    """What changes about sessions of rollouts: folder, branch, version, provider, model."""
    from quillmeter.sources.codex import _items

    rows = _items(spark, path).where(get("j", "$.type").isin("session_meta", "turn_context"))
    head = get("j", "$.type") == "session_meta"
    p = "$.payload."
    stated = rows.select("file", "line", F.lit("codex").alias("source"), "session_id", "ts", word("j", p + "cwd").alias("cwd"), F.when(head, word("j", p + "git.branch")).alias("git_branch"), F.when(head, word("j", p + "cli_version")).alias("agent_version"), F.when(head, word("j", p + "forked_from_id")).alias("parent_session_id"), F.when(~head, word("j", p + "model")).alias("model"), F.when(head, word("j", p + "model_provider")).alias("raw_provider"))
    return changed_facts(carried_time(stated, ["file"])).withColumnRenamed("line", "event_index")
