"""Usage rows from SQLite databases, as Spark data sources: one partition a file."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import numbers
from quillmeter.sources.raw import count, first_time, get, session_of, timestamp_of, usage_rows, word


def query_files(spark: SparkSession, path: str, sql: list[str], columns: list[str], glob: str = "*.db") -> DataFrame:
    """Rows (file, columns as text) of the first of the queries that each database can run.

    Files come through Spark's reader, so they may lie in any store; a write-ahead log beside a
    database is opened with it, as it holds commits that are not in the database yet. Databases
    whose tables or columns answer none of the queries give no rows; any other error fails the
    job. The copies that sqlite opens lie in the task's own temporary folder and end with it.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = read.option("pathGlobFilter", glob).load(path).select("path", "content")
    logs = read.option("pathGlobFilter", glob + "-wal").load(path).select(F.regexp_replace("path", "-wal$", "").alias("path"), F.col("content").alias("wal"))
    files = files.join(logs, "path", "left").select("path", "content", "wal")
    schema = ", ".join(["file string", *(f"`{c}` string" for c in columns)])

    def one(name: str, content: bytes, wal: bytes | None) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory() as folder:
            held = os.path.join(folder, "held.db")
            for at, data in ((held, content), (held + "-wal", wal)):
                if data:
                    with open(at, "wb") as out:
                        out.write(data)
            db = sqlite3.connect(held)
            try:
                for statement in sql:
                    try:
                        found = db.execute(statement)
                    except sqlite3.OperationalError as error:
                        if str(error).startswith(("no such table", "no such column", "no such function")):
                            continue
                        raise
                    for row in found:
                        yield (name, *(None if v is None else v.hex() if isinstance(v, bytes) else str(v) for v in row))
                    return
            finally:
                db.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", *columns]
        for batch in batches:
            for name, content, wal in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                rows = []
                for row in one(name, content.as_py(), wal.as_py()):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def goose(spark: SparkSession, path: str) -> DataFrame:
    """One row a session: accumulated counts if there, and the total that input and output leave over as reasoning."""
    columns = ["id", "model", "provider", "created", "total", "input", "output"]
    base = "select id, model_config_json, provider_name, created_at, {} from sessions"
    wide = base.format("coalesce(accumulated_total_tokens, total_tokens), coalesce(accumulated_input_tokens, input_tokens), coalesce(accumulated_output_tokens, output_tokens)")
    rows = query_files(spark, path, [wide, base.format("total_tokens, input_tokens, output_tokens")], columns)
    rows = rows.withColumn("j", F.try_parse_json("model"))
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)))
    hidden = F.greatest(F.lit(0), n("total") - n("input") - n("output"))
    return usage_rows(rows, "goose", session_id=F.col("id"), ts=timestamp_of(F.col("created")), provider=F.col("provider"), model=word("j", "$.model_name"), input_tokens=n("input"), output_tokens=n("output") + hidden, reasoning_tokens=hidden, total_tokens=n("total"))


def opencode(spark: SparkSession, path: str) -> DataFrame:
    """Requests of assistant messages of both layouts; what the older one has isn't taken from the newer one again.

    A message of the older layout with several finished steps is one request a step, in the order
    of their ids. Output holds reasoning already where the older layout's total says so or names
    none; the newer one always keeps it apart.
    """
    steps = "(select json_group_array(json_object('id', p.id, 'time', {time}, 'part', json(p.data))) from part p where p.message_id = m.id and json_extract(p.data, '$.type') = 'step-finish')"
    named = "select m.id, m.session_id, m.time_created, m.data, {} from message m"
    old = query_files(spark, path, [named.format(steps.format(time="p.time_created")), named.format(steps.format(time="null")), named.format("null"), "select id, null, null, data, null from message"], ["id", "session", "created", "data", "steps"])
    new = query_files(spark, path, ["select s.id, s.session_id, s.time_created, s.data, v.directory from session_message s left join session_v2 v on v.id = s.session_id where s.type = 'assistant'", "select id, session_id, time_created, data, null from session_message"], ["id", "session", "created", "data", "directory"])
    new = new.join(old.select("file", "id"), ["file", "id"], "left_anti")
    none = F.lit(None).cast("string")
    both = old.withColumns({"directory": none, "v2": F.lit(False)}).unionByName(new.withColumns({"steps": none, "v2": F.lit(True)}))
    rows = both.withColumn("j", F.try_parse_json("data"))
    rows = rows.where(F.lower(F.coalesce(get("j", "$.role", "$.type"), F.when(F.col("v2"), "assistant"))) == "assistant")
    told = F.coalesce(F.try_variant_get(F.try_parse_json("steps"), "$", "array<variant>"), F.array().cast("array<variant>"))
    told = F.array_sort(told, lambda a, b: F.when(F.try_variant_get(a, "$.id", "string") < F.try_variant_get(b, "$.id", "string"), -1).when(F.try_variant_get(a, "$.id", "string") > F.try_variant_get(b, "$.id", "string"), 1).otherwise(0))
    # one step says the same as its message
    request = F.when(F.size(told) > 1, F.transform(told, lambda s, i: F.struct(i.alias("n"), F.try_variant_get(s, "$.time", "string").alias("at"), F.try_variant_get(s, "$.part", "variant").alias("x")))).otherwise(F.array(F.struct(F.lit(0).alias("n"), none.alias("at"), F.col("j").alias("x"))))
    rows = rows.select("*", F.explode(request).alias("r")).select("*", "r.n", "r.at", "r.x")
    t = "$.tokens."
    given, said, thought, read, written, total = (count("x", t + n) for n in ("input", "output", "reasoning", "cache.read", "cache.write", "total"))
    holds = ~F.col("v2") & (said >= thought) & ((total == 0) | (total == given + said + read + written))
    output = F.when(holds, said).otherwise(said + thought)
    model = F.coalesce(word("j", "$.modelID"), word("j", "$.model.modelID", "$.model.id"), word("j", "$.model"))
    return usage_rows(rows, "opencode", session_id=F.coalesce("session", word("j", "$.sessionID", "$.sessionId", "$.session_id"), F.col("id")), ts=F.coalesce(timestamp_of(F.col("at")), timestamp_of(F.col("created")), first_time("j", "$.time.created")), repo_root=F.coalesce(word("j", "$.path.root", "$.path.cwd"), F.col("directory")), provider=word("j", "$.providerID", "$.model.providerID", "$.provider"), model=model, input_tokens=given, output_tokens=output, reasoning_tokens=thought, cache_read_tokens=read, cache_write_tokens=written, total_tokens=total, cost_usd=numbers.usd(get("x", "$.cost")), single_request=F.lit(True), message_id=F.col("id"), event_index=F.col("n").cast("bigint"))


def proto_fields(data: bytes) -> list[tuple[int, int, object]]:
    """(field, wire type, value) of a protobuf message, varints as integers, the rest as bytes; a broken tail ends it."""
    found, at = [], 0

    def varint() -> int | None:
        nonlocal at
        value = shift = 0
        while at < len(data) and shift < 64:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
        return None

    while at < len(data):
        key = varint()
        if key is None or key >> 3 == 0:
            break
        kind = key & 7
        if kind == 0:
            value: object = varint()
            if value is None:
                break
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            if size is None or at + size > len(data):
                break
            value = data[at : at + size]
            at += size
        else:
            break
        found.append((key >> 3, kind, value))
    return found


# The fields on the way to a turn's model, time and usage, and those of the usage.
TURN, USAGE, WRAPPED_TIME, TIME, MODEL, CREATED = 1, 4, 9, 4, 19, 2
USAGE_FIELDS = {"input": 2, "output": 3, "cached": 5, "visible": 9, "reasoning": 10, "response": 11}


def first_field(fields: list[tuple[int, int, object]], number: int, kind: int):
    """The first value of a field of that wire type, or None."""
    return next((v for n, k, v in fields if (n, k) == (number, kind)), None)


def time_of(blob: bytes | None) -> int | None:
    """Milliseconds of a message of seconds and nanoseconds."""
    fields = proto_fields(blob or b"")
    seconds = first_field(fields, 1, 0)
    return None if seconds is None else seconds * 1000 + (first_field(fields, 2, 0) or 0) // 1_000_000


def turn_of(blob: bytes) -> tuple | None:
    """(input, output, cached, reasoning, response, model, ms) of one turn's metadata; None without usage.

    Output is what is visible and what was thought; a turn's own time is null where it has none.
    """
    chat = first_field(proto_fields(blob), TURN, 2)
    fields = proto_fields(chat or b"")
    usage = first_field(fields, USAGE, 2)
    if usage is None:
        return None
    own = proto_fields(usage)
    number = lambda name: first_field(own, USAGE_FIELDS[name], 0)
    thought = number("reasoning") or 0
    output = number("output")
    output = (number("visible") or 0) + thought if output is None else output
    text = lambda value: None if value is None else value.decode("utf-8", "replace").strip() or None
    wrapped = first_field(fields, WRAPPED_TIME, 2)
    at = time_of(first_field(proto_fields(wrapped), TIME, 2)) if wrapped is not None else None
    return number("input") or 0, output, number("cached") or 0, thought, text(first_field(own, USAGE_FIELDS["response"], 2)), text(first_field(fields, MODEL, 2)), at


def antigravity(spark: SparkSession, path: str) -> DataFrame:
    """Turns of conversations, one database each: protobuf blobs in the order of their numbers, the first of each response.

    A turn without a time of its own has that of the conversation. Blobs are decoded batch by
    batch in the worker that Arrow feeds.
    """
    turns = query_files(spark, path, ["select idx, data from gen_metadata order by idx"], ["idx", "blob"])
    created = query_files(spark, path, ["select data from trajectory_metadata_blob limit 1"], ["made"])
    names = "input output cached reasoning response model ms".split()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [turn_of(bytes.fromhex(b)) if b else None for b in batch.column(2).to_pylist()]
            made = [(*((None,) * 6 if f is None else f[:6]), (f and f[6]) if (f and f[6]) is not None else time_of(first_field(proto_fields(bytes.fromhex(m or "")), CREATED, 2))) for f, m in zip(found, batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["file", "idx", *names])

    rows = turns.join(created, "file", "left").select("file", "idx", "blob", "made")
    rows = rows.mapInArrow(decode, "file string, idx string, input bigint, output bigint, cached bigint, reasoning bigint, response string, model string, ms bigint")
    rows = rows.withColumn("n", F.col("idx").cast("bigint"))
    used = F.coalesce(F.greatest("input", "output", "cached", "reasoning") > 0, F.lit(False))
    first = F.row_number().over(Window.partitionBy("file", F.coalesce("response", F.concat(F.lit("#"), "idx")), used).orderBy("n"))
    rows = rows.withColumn("_first", first).where("_first = 1")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return usage_rows(rows, "antigravity", session_id=session_of(F.col("file")), ts=timestamp_of(F.col("ms").cast("string")), model=F.col("model"), input_tokens=zero("input"), output_tokens=zero("output"), reasoning_tokens=zero("reasoning"), cache_read_tokens=zero("cached"), single_request=F.lit(True), message_id=F.col("response"), event_index=F.col("n"))


READERS = {"goose": goose, "opencode": opencode, "antigravity": antigravity}
