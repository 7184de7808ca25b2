"""Exports: events as JSON lines or CSV, telemetry, report envelopes, Markdown, the ledger, machine bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions.calendar import day_start_utc, epoch_ms, period_key
from quillmeter.functions.text import csv_guard
from quillmeter.operators.dedupe import content_hash

EVENT_COLUMNS = ["source", "session_id", "ts", "repo_root", "provider", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd", "cost_mode", "machine"]


def in_export_order(usage: DataFrame) -> DataFrame:
    return usage.orderBy("ts", "source", "session_id", "event_index")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_jsonl(usage: DataFrame, path: str) -> None:
    in_export_order(usage).select(*[iso(F.col(c)).alias("timestamp") if c == "ts" else F.col(c) for c in EVENT_COLUMNS]).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_csv(usage: DataFrame, path: str) -> None:
    """CSV with a header; text that a spreadsheet would run is guarded."""
    types = dict(usage.dtypes)
    guard = lambda c: iso(F.col(c)).alias("timestamp") if c == "ts" else csv_guard(F.col(c)).alias(c) if types[c] == "string" else F.col(c)
    in_export_order(usage).select(*[guard(c) for c in EVENT_COLUMNS]).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Count, sum, least, most, and counts of values in (bounds[i-1], bounds[i]] with one bucket above all."""
    v = F.col(value)
    tests = []
    for i in range(len(bounds) + 1):
        test = F.lit(True)
        if i:
            test = test & (v > bounds[i - 1])
        if i < len(bounds):
            test = test & (v <= bounds[i])
        tests.append(F.count_if(test))
    return df.groupBy(*keys).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.array(*tests).alias("buckets"))


def trace_id(source: Column, session: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", source, session).cast("binary"), 256), 1, 32)


def span_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 16)


def otlp_traces(usage: DataFrame) -> DataFrame:
    """(source, traceId, span): one trace a session, a row a span; ids repeat from run to run."""
    nth = F.row_number().over(_window(["source", "session_id", "_hash"], ["ts", "event_index"]))
    rows = usage.withColumn("_hash", content_hash(usage)).withColumn("_nth", nth)
    nanos = (epoch_ms(F.col("ts")) * 1_000_000).cast("string")
    attributes = otlp_attributes({"gen_ai.request.model": F.col("model"), "gen_ai.provider.name": F.col("provider"), "gen_ai.usage.input_tokens": F.col("input_tokens"), "gen_ai.usage.output_tokens": F.col("output_tokens")})
    span = F.struct(nanos.alias("startTimeUnixNano"), nanos.alias("endTimeUnixNano"), span_id(F.col("_hash"), F.col("_nth").cast("string")).alias("spanId"), F.lit("chat").alias("name"), attributes.alias("attributes"))
    return rows.select("source", trace_id(F.col("source"), F.col("session_id")).alias("traceId"), span.alias("span"))


def otlp_attributes(values: dict[str, Column]) -> Column:
    """Attributes as pairs of key and text value, in the order given; nulls are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
    return F.filter(F.array(*pairs), lambda a: a["value"].isNotNull())


#: Token metrics of a day, and the bounds of their histograms.
METRIC_BOUNDS = [float(4**i) for i in range(1, 15)]


def otlp_metrics(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """(day, source, metric, start_nanos, end_nanos, sum, histogram): the change of a local day, by source.

    A day's points begin with it and end with the next; cost has a sum only, and none where no
    event has a cost.
    """
    day = period_key(F.col("ts"), "day", tz).alias("day")
    rows = usage.select(day, "source", F.expr("stack(5, 'input', input_tokens, 'output', output_tokens, 'reasoning', reasoning_tokens, 'cache_read', cache_read_tokens, 'cache_write', cache_write_tokens) as (metric, value)"))
    found = histogram(rows, ["day", "source", "metric"], "value", METRIC_BOUNDS)
    tokens = found.select("day", "source", "metric", F.col("sum").cast("double").alias("sum"), F.struct("count", "min", "max", "buckets").alias("histogram"))
    cost = usage.groupBy(day, "source").agg(F.sum(F.col("cost_usd").cast("decimal(38,12)")).cast("double").alias("sum")).where("sum is not null").select("day", "source", F.lit("cost").alias("metric"), "sum", F.lit(None).cast(tokens.schema["histogram"].dataType).alias("histogram"))
    nanos = lambda shift: epoch_ms(day_start_utc(F.date_add(F.col("day").cast("date"), shift), tz)) * 1_000_000
    return tokens.unionByName(cost).select("day", "source", "metric", nanos(0).alias("start_nanos"), nanos(1).alias("end_nanos"), "sum", "histogram")


def _window(keys: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def write_otlp(usage: DataFrame, path: str) -> None:
    otlp_traces(usage).select(F.to_json(F.struct("traceId", "source", "span")).alias("value")).write.mode("overwrite").text(path)


#: Rows that a finished report has at most where it is put together as one text.
REPORT_ROWS = 10_000


def _finished(report: DataFrame, most: int) -> list:
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is written as files, not as one text")
    return rows


def envelope(report: DataFrame, name: str, version: int = 1, most: int = REPORT_ROWS) -> str:
    """A finished report of `most` rows at most as {schemaVersion, report, data}; a larger one is refused."""
    import json

    rows = _finished(report.select(F.to_json(F.struct(*report.columns)).alias("j")), most)
    return json.dumps({"schemaVersion": version, "report": name, "data": [json.loads(r["j"]) for r in rows]})


def markdown(report: DataFrame, most: int = REPORT_ROWS) -> str:
    """A finished report of `most` rows at most as a table; cells can't break it."""
    cell = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")
    rows = [report.columns, ["---"] * len(report.columns), *_finished(report, most)]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in rows)


def terminal_table(report: DataFrame, width: int = 100, most: int = REPORT_ROWS) -> str:
    """A finished report as aligned lines no wider than `width`: numbers to the right, long text cut in its middle."""
    from quillmeter.functions.format import terminal_line, truncate_middle

    found = _finished(report, most)
    numeric = [t in ("bigint", "int", "double") or t.startswith("decimal") for _, t in report.dtypes]
    cells = [[terminal_line("-" if v is None else f"{v:,}" if isinstance(v, int) else f"{v:,.2f}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    widths = [max(len(x) for x in column) for column in zip(report.columns, *cells, strict=True)]
    room = width - 2 * (len(widths) - 1)
    while sum(widths) > room and max(widths) > 8:
        widest = widths.index(max(widths))
        widths[widest] = max(8, widths[widest] - (sum(widths) - room))
    line = lambda row: "  ".join((truncate_middle(x, w).rjust(w) if right else truncate_middle(x, w).ljust(w)) for x, w, right in zip(row, widths, numeric, strict=True)).rstrip()
    return "\n".join([line(report.columns), line(["-" * w for w in widths]), *map(line, cells)])


def heatmap(levels: DataFrame, today: str) -> str:
    """The 53 weeks that end with today's as seven lines, Monday first, of levels(day, level); days without one are blank, days to come dots."""
    import datetime

    from quillmeter.functions.ranges import activity_start

    start, last = datetime.date.fromisoformat(activity_start(today)), datetime.date.fromisoformat(today)
    held = {r["day"]: r["level"] for r in levels.where(F.col("day").between(start.isoformat(), today)).limit(53 * 7).collect()}
    days = [[start + datetime.timedelta(7 * w + d) for w in range(53)] for d in range(7)]
    return "\n".join("".join("·" if day > last else " ░▒▓█"[held.get(day.isoformat(), 0)] for day in row) for row in days)


BARS = "▁▂▃▄▅▆▇█"


def sparkline(values: list[float], width: int) -> str:
    """Peaks of equal stretches as bars; 0 is blank."""
    n = len(values)
    if n > width:
        values = [max(values[i * n // width : max((i + 1) * n // width, i * n // width + 1)]) for i in range(width)]
    most = max(values, default=0)
    return "".join(" " if v <= 0 else BARS[min(7, max(0, round(v / most * 7)))] for v in values)


LEDGER_KEYS = ["source", "file_hash"]


def _ledger_rows(usage: DataFrame) -> DataFrame:
    return usage.withColumn("file_hash", F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 16))


def write_ledger(usage: DataFrame, path: str) -> None:
    """Replaces the files of usage in the ledger, a table by source and file, in one dynamic overwrite.

    A file's rows have to be all of that file's; for rows of a part of a file there is upsert_ledger.
    """
    _ledger_rows(usage).repartition(*LEDGER_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LEDGER_KEYS).parquet(path)


def read_ledger(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The ledger's rows, or those from the instant since on and before until; bounds reach the scan."""
    rows = spark.read.parquet(path).drop("file_hash")
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")) if until else rows


def upsert_ledger(usage: DataFrame, path: str) -> None:
    """Adds rows to the ledger; a row with the place (source, file, event_index) of a stored one replaces it.

    Only partitions of files that usage has are read and written again.
    """
    spark = usage.sparkSession
    fresh = _ledger_rows(usage)
    place = [*LEDGER_KEYS, "file", "event_index"]
    latest = F.row_number().over(_window(place, ["ts"]))
    fresh = fresh.withColumn("_n", latest).where("_n = 1").drop("_n")
    if _exists(spark, path):
        stored = spark.read.schema(fresh.schema).parquet(path).join(fresh.select(*LEDGER_KEYS).distinct(), LEDGER_KEYS, "left_semi")
        fresh = fresh.unionByName(stored.join(fresh.select(*place), place, "left_anti").select(*fresh.columns))
    fresh.repartition(*LEDGER_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LEDGER_KEYS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """(source, files, sessions, events, first_ms, last_ms) of what is stored."""
    return ledger.groupBy("source").agg(F.count_distinct("file").alias("files"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"), F.min(epoch_ms(F.col("ts"))).alias("first_ms"), F.max(epoch_ms(F.col("ts"))).alias("last_ms"))


def live_files(ledger: DataFrame, discovered: DataFrame) -> DataFrame:
    """(source, file, live): the stored files, and whether they are still among discovered(source, file)."""
    there = discovered.select("source", "file").distinct().withColumn("live", F.lit(True))
    return ledger.select("source", "file").distinct().join(there, ["source", "file"], "left").withColumn("live", F.coalesce("live", F.lit(False)))


def ledger_health(ledger: DataFrame, discovered: DataFrame) -> DataFrame:
    """By source: stored files and events, files that are gone, files found that aren't stored, rows that name one place twice."""
    stored = ledger.groupBy("source", "file").agg(F.count("*").alias("events"), (F.count("*") - F.count_distinct("event_index")).alias("repeated"))
    found = discovered.select("source", "file").distinct().withColumn("found", F.lit(True))
    both = stored.join(found, ["source", "file"], "full")
    return both.groupBy("source").agg(F.count("events").alias("files"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count_if(F.col("found").isNull()).alias("gone"), F.count_if(F.col("events").isNull()).alias("unstored"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"))


def snapshots(usage: DataFrame) -> DataFrame:
    """(source, file, revision, events): a digest of a file's events that doesn't depend on their order.

    It is made of sums over the events' hashes, so a large file is never gathered.
    """
    h = content_hash(usage)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(20,0)"))
    sums = usage.withColumn("_h", h).groupBy("source", "file").agg(part(1).alias("_a"), part(9).alias("_b"), F.sum(F.xxhash64("_h").cast("decimal(38,0)")).alias("_c"), F.count("*").alias("events"))
    return sums.select("source", "file", F.sha2(F.concat_ws(":", "_a", "_b", "_c", "events").cast("binary"), 256).alias("revision"), "events")


def write_bundle(usage: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """A machine's events as lines of JSON, an event a line: files that the reader knows at their revision are left out.

    A line a file states its revision and number of events, an end line those of files and events.
    """
    revisions = snapshots(usage)
    fresh = revisions if known is None else revisions.join(known.select("source", "file", "revision"), ["source", "file", "revision"], "left_anti")
    body = F.struct(*[c for c in usage.columns if c not in ("source", "file")])
    events = usage.join(fresh.select("source", "file"), ["source", "file"], "left_semi").select(F.to_json(F.struct(F.lit("event").alias("type"), "source", "file", body.alias("event"))).alias("value"))
    files = fresh.select(F.to_json(F.struct(F.lit("file").alias("type"), "source", "file", "revision", "events")).alias("value"))
    end = fresh.agg(F.to_json(F.struct(F.lit("end").alias("type"), F.count("*").alias("files"), F.coalesce(F.sum("events"), F.lit(0)).alias("eventCount"))).alias("value"))
    events.unionByName(files).unionByName(end).write.mode("overwrite").text(path)


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a bundle; one without exactly one end line, or whose files and events aren't those that it states, is refused."""
    raw = spark.read.text(path).withColumn("type", F.get_json_object("value", "$.type"))
    number = lambda name: F.get_json_object("value", f"$.{name}").cast("bigint")
    ends = raw.where("type = 'end'").select(number("files").alias("files"), number("eventCount").alias("events")).limit(2).collect()
    if len(ends) != 1:
        raise ValueError("the bundle is incomplete: it has no end, or several")
    place = [F.get_json_object("value", "$.source").alias("source"), F.get_json_object("value", "$.file").alias("file")]
    stated = raw.where("type = 'file'").select(*place, number("events").alias("stated"))
    held = raw.where("type = 'event'").groupBy(*place).agg(F.count("*").alias("held"))
    both = stated.join(held, (stated.source.eqNullSafe(held.source)) & (stated.file.eqNullSafe(held.file)), "full")
    sums = both.agg(F.count("stated").alias("files"), F.coalesce(F.sum("held"), F.lit(0)).alias("events"), F.count_if(~F.coalesce("stated", F.lit(-1)).eqNullSafe(F.coalesce("held", F.lit(0)))).alias("odd")).first()
    if (sums["files"], sums["events"]) != (ends[0]["files"], ends[0]["events"]) or sums["odd"]:
        raise ValueError("the bundle is incomplete: it doesn't hold what its end states")
    events = raw.where("type = 'event'").select(F.from_json("value", f"source string, file string, event struct<{schema}>").alias("e"))
    return events.select("e.source", "e.file", "e.event.*")


def apply_bundle(events: DataFrame, cache: str, machine: str) -> None:
    """Replaces, in a machine's part of the cache, the files that events has; the rest of it and other machines stay."""
    rows = _ledger_rows(events.withColumn("machine", F.lit(machine)))
    keys = ["machine", *LEDGER_KEYS]
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(cache)


def read_cache(spark: SparkSession, cache: str, machines: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Cached events of machines, in a window; both reach the scan."""
    rows = read_ledger(spark, cache, since, until)
    return rows.where(F.col("machine").isin(machines)) if machines is not None else rows


def prune(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """ledger without the files in gone(source, file)."""
    return ledger.join(gone.select("source", "file"), ["source", "file"], "left_anti")


def prunable(ledger: DataFrame, discovered: DataFrame, source: str | None = None, before: str | None = None) -> DataFrame:
    """(source, file, events, last_ms): stored files that are gone, of one source and without events from a date on, if these are given."""
    rows = ledger.join(discovered.select("source", "file").distinct(), ["source", "file"], "left_anti")
    if source:
        rows = rows.where(F.col("source") == source)
    found = rows.groupBy("source", "file").agg(F.count("*").alias("events"), F.max(epoch_ms(F.col("ts"))).alias("last_ms"))
    return found.where(F.col("last_ms") < epoch_ms(F.lit(before).cast("timestamp_ntz"))) if before else found


def write_session_events(events: DataFrame, path: str) -> None:
    """Session events into their part of the ledger, by source and file; a row replaces the one stored for its place."""
    upsert_ledger(events, path)


def read_session_events(spark: SparkSession, path: str, kinds: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Stored session events of kinds and files(source, file), in their order within a file."""
    rows = read_ledger(spark, path)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows if files is None else rows.join(files.select("source", "file").distinct(), ["source", "file"], "left_semi")


def migrate_ledger(spark: SparkSession, old: str, new: str, change, parts: int = 16) -> None:
    """Rewrites a ledger through change, a function of frames, in ranges of its keys one after the other; a range that is there already is replaced."""
    if not 1 <= parts <= 16:
        raise ValueError("a range is told by one of 16 digits")
    stored = spark.read.parquet(old)
    digits = "0123456789abcdef"
    for i in range(parts):
        mine = [d for n, d in enumerate(digits) if n * parts // 16 == i]
        rows = change(stored.where(F.substring("file_hash", 1, 1).isin(mine)))
        rows.repartition(*LEDGER_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LEDGER_KEYS).parquet(new)


def push_otlp(rows: DataFrame, url: str, batch: int = 500, tries: int = 4, wait: float = 0.5, headers: dict[str, str] | None = None) -> int:
    """Posts rows as JSON arrays of `batch` at most from where they are; returns their number.

    A batch that the receiver can't take now (429, 5xx, no connection) is tried again, each time
    after twice the wait; anything else, or the last try, fails the job. A task that is run again
    sends its batches again: ids repeat from run to run, so that the receiver can tell.
    """
    import json
    import time
    import urllib.error
    import urllib.request

    sent = rows.sparkSession.sparkContext.accumulator(0)
    own = {"Content-Type": "application/json"} | (headers or {})

    def post(lines: list[str]) -> None:
        body = json.dumps([json.loads(x) for x in lines]).encode()
        for n in range(tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, own, method="POST"), timeout=30):
                    return
            except urllib.error.HTTPError as error:
                if n + 1 == tries or not (error.code == 429 or error.code >= 500):
                    raise
            except urllib.error.URLError:
                if n + 1 == tries:
                    raise
            time.sleep(wait * 2**n)

    def part(found) -> None:
        lines: list[str] = []
        for row in found:
            lines.append(row["value"])
            if len(lines) == batch:
                post(lines)
                sent.add(len(lines))
                lines = []
        if lines:
            post(lines)
            sent.add(len(lines))

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).foreachPartition(part)
    return sent.value


def share_page(cells: DataFrame, title: str, most: int = 200_000) -> str:
    """A page of its own that holds cells as data and sums them by any dimension; nothing in the data can end its script."""
    import html
    import json

    rows = [json.loads(r["j"]) for r in _finished(cells.select(F.to_json(F.struct(*cells.columns)).alias("j")), most)]
    data = json.dumps(rows, ensure_ascii=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    script = """const by=document.getElementById('by'),out=document.getElementById('out');
for(const k of ['period','source','model','project','machine']){const o=document.createElement('option');o.textContent=k;by.append(o)}
function show(){const sums=new Map();for(const c of cells){const k=String(c[by.value]),s=sums.get(k)||[0,0,0];s[0]+=c.events;s[1]+=c.total_tokens;s[2]+=c.cost_usd||0;sums.set(k,s)}
out.replaceChildren();for(const [k,s] of [...sums].sort((a,b)=>b[1][1]-a[1][1])){const r=out.insertRow();for(const v of [k,s[0],s[1],s[2].toFixed(2)])r.insertCell().textContent=v}}
by.onchange=show;show()"""
    name = html.escape(title)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{name}</title><h1>{name}</h1><select id="by"></select><table><thead><tr><th>name<th>events<th>tokens<th>USD</thead><tbody id="out"></tbody></table><script>const cells={data};{script}</script></html>'
