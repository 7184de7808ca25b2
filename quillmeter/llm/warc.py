"""WARC archives: writing captures as request, response or revisit and metadata records, and joining them again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm.common import prepare, shared_folder

#: Bytes of payload in one archive at most, unless a single page has more.
FILE_BYTES = 256 << 20
#: Rows with this many at most go to all executors at once; more are shuffled.
BROADCAST_ROWS = 200_000

LINE = "\r\n"


def base32_sha1(binary):
    """The bare upper-case base32 SHA-1 of a binary column, by five groups of 40 bits."""
    digits = F.sha1(binary)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind, ident, more: list[tuple[str, object]], media: str, block):
    """A record without its last line end; `more` has pairs of name and text column, null values are left out."""
    size = F.octet_length(block)
    heads = [F.lit(f"WARC/1.1{LINE}WARC-Type: "), kind, F.lit(f"{LINE}WARC-Record-ID: <"), ident, F.lit(f">{LINE}WARC-Date: 2024-01-01T00:00:00Z")]
    for name, value in more:
        heads.append(F.coalesce(F.concat(F.lit(f"{LINE}{name}: "), value), F.lit("")))
    return F.concat(*heads, F.lit(f"{LINE}Content-Type: {media}{LINE}Content-Length: "), size.cast("string"), F.lit(LINE + LINE), block, F.lit(LINE))


def clean_url(column):
    """A URL in one line: header fields can't hold line ends."""
    return F.regexp_replace(F.coalesce(column, F.lit("urn:unknown")), r"[\x00-\x20\x7f]", "")


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html) as gzip'ed WARC files below path, three records a page.

    Payloads are the html in UTF-8, null as empty. Of pages with equal payloads of `least` bytes
    or more, the one with the smallest page_id is a response and the others are revisits without a
    body; rows that share the smallest page_id are responses all, and so is a page without an id.
    The metadata record has the payload's length. Record identifiers name the page and, as ids may
    repeat, a random part that is made in the same task as the records and read back from them.
    Files hold 1,000 pages at most, and so few that their payloads stay below FILE_BYTES.
    """
    prepare(pages)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), clean_url(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    payload = F.encode("html", "UTF-8")
    p = p.withColumn("digest", base32_sha1(payload)).withColumn("size", F.octet_length(payload))
    groups = p.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    groups = groups.where("first < last").select("digest", "first")
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    p = p.join(groups, "digest", "left")
    p = p.withColumn("refers", F.when((F.col("first") < F.col("page_id")) & (F.col("size") >= least), F.col("first")))
    p = p.withColumn("name", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.uuid()))
    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("unknown"))
    response = F.concat("name", F.lit(":response"))
    concurrent = F.concat(F.lit("<"), response, F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("size").cast("string"), F.lit(LINE + LINE))
    again = F.col("refers").isNotNull()
    common = [("WARC-Target-URI", F.col("url"))]
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record(F.lit("request"), F.concat("name", F.lit(":request")), [*common, ("WARC-Concurrent-To", concurrent)], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{LINE}Host: "), host, F.lit(LINE + LINE)))
    refers = F.when(again, F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">")))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = _record(F.when(again, "revisit").otherwise("response"), response, [*common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers), ("WARC-Profile", profile)], "application/http; msgtype=response", F.when(again, http).otherwise(F.concat(http, F.col("html"))))
    fields = F.concat(F.lit("payload-length: "), F.col("size").cast("string"), F.lit(LINE))
    about = _record(F.lit("metadata"), F.concat("name", F.lit(":metadata")), [*common, ("WARC-Concurrent-To", concurrent)], "application/warc-fields", fields)
    # a row is three records; the writer's line end is the last of each
    lines = p.select(F.concat(request, F.lit(LINE), main, F.lit(LINE), about).alias("value"))
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first()["n"] or 1
    lines.write.option("lineSep", LINE).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", max(1, min(1000, FILE_BYTES // longest))).mode("errorifexists").text(path)


class DamagedArchive(ValueError):
    """An archive that ends within a record, or has a record without a length."""


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, gzip'ed or plain.

    Blocks are found by Content-Length alone, so a body that holds "WARC/1.1" is no trouble. A
    record that is cut off, or whose length is no number, raises DamagedArchive after those before
    it; so does a broken gzip member. Zeros after the last member are padding.
    """
    whole = True
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            one = zlib.decompressobj(31)
            try:
                parts.append(one.decompress(data))
            except zlib.error:
                whole = False
                break
            whole = one.eof
            data = one.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise DamagedArchive("a record's header is cut off")
        fields = {}
        for line in data[at:stop].decode("utf-8", "replace").split(LINE)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise DamagedArchive("a record has no length")
        size = int(fields["content-length"])
        if stop + 4 + size > len(data):
            raise DamagedArchive("a record's block is cut off")
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
    if not whole:
        raise DamagedArchive("a gzip member is cut off")


RECORDS = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, content_type string, block_bytes bigint, payload_bytes bigint, payload_sha1 string, payload binary, payload_length bigint"


def read_records(spark: SparkSession, path: str, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """One row a record of the archives below path.

    Of http records, payload_bytes and payload_sha1 (bare base32) are those of the body as it was
    read; the body itself is payload unless payloads is False. payload_digest is what the header
    states. A damaged archive fails the job, or ends early where damaged is "skip".
    """
    if damaged not in ("raise", "skip"):
        raise ValueError(damaged)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    prepare(files)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def bare(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def all_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        try:
            yield from records_of(data)
        except DamagedArchive:
            if damaged == "raise":
                raise

    def rows(data: bytes) -> Iterator[tuple]:
        for h, block in all_of(data):
            payload, length, size, sha1 = None, None, None, None
            if "application/http" in h.get("content-type", ""):
                _, cut, body = block.partition(b"\r\n\r\n")
                if cut:
                    payload = body if payloads else None
                    size, sha1 = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            elif "warc-fields" in h.get("content-type", ""):
                for line in block.decode("utf-8", "replace").splitlines():
                    name, _, value = line.partition(":")
                    if name == "payload-length" and value.strip().isdigit():
                        length = int(value)
            digest = h.get("warc-payload-digest")
            yield bare(h.get("warc-record-id")), h.get("warc-type"), bare(h.get("warc-concurrent-to")), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), digest.removeprefix("sha1:") if digest else None, h.get("content-type"), len(block), size, sha1, payload, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                made: list[tuple] = []
                for row in rows(value.as_py()):
                    made.append(row)
                    if len(made) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
                        made = []
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, response, requests and metadata that name it as concurrent.

    Joins go both ways of WARC-Concurrent-To: a request or metadata record that names a response,
    and one that a response names. A response without such records keeps its row with empty lists;
    records that name no capture here are left out. Repeated records stay in the lists.
    """
    own = ["record_id", "type", "target_uri", "refers_to", "payload_digest", "content_type", "block_bytes", "payload_bytes", "payload_sha1", "payload", "payload_length"]
    captures = records.where("type in ('response', 'revisit', 'resource')")
    others = records.where("type in ('request', 'metadata')")
    named = others.where("concurrent_to is not null").withColumn("capture", F.col("concurrent_to"))
    naming = captures.where("concurrent_to is not null").select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    linked = named.unionByName(others.join(naming, "record_id").select(*others.columns, "capture"))
    # bodies of requests and metadata are short, but payloads of captures are not: only the former are gathered
    groups = linked.groupBy("capture").agg(
        F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "block_bytes"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "payload_length", "block_bytes"))).alias("metadata"),
    )
    joined = captures.select("record_id", F.struct(*own).alias("response")).join(groups, F.col("record_id") == F.col("capture"), "left")
    empty = lambda c: F.coalesce(c, F.filter(c, lambda _: F.lit(False)), F.from_json(F.lit("[]"), dict(joined.dtypes)[c]))
    return joined.select("record_id", "response", empty("requests").alias("requests"), empty("metadata").alias("metadata"))


def page_of(name: str) -> Column:
    """The page's id in a record's or page's name, or null."""
    return F.expr(f"try_cast(nullif(regexp_extract({name}, '^urn:page:(-?[0-9]+)', 1), '') as bigint)")


def page_captures(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, n_requests) of transactions that write_archives wrote.

    Length and digest are those of the body that was read: a response's own; of a revisit, which
    has none, the body of the response it refers to. A revisit is tied to a response of that page
    whose body has the digest that the revisit states; without one, both figures are null.
    """
    page, refers = page_of("record_id"), page_of("response.refers_to")
    rows = captures.select(page.alias("page_id"), F.col("response.type").alias("record_type"), refers.alias("refers_to"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_sha1").alias("own_sha1"), F.col("response.payload_digest").alias("stated"), F.size("requests").alias("n_requests"))
    revisits = rows.where("record_type = 'revisit'")
    first = revisits.select(F.col("refers_to").alias("id")).distinct()
    bodies = rows.where("record_type <> 'revisit'").join(first, F.col("page_id") == F.col("id"), "left_semi")
    bodies = bodies.groupBy(F.col("page_id").alias("body_id"), F.col("own_sha1").alias("body_sha1")).agg(F.max("own_bytes").alias("body_bytes"))
    again = revisits.join(bodies, (F.col("refers_to") == F.col("body_id")) & (F.col("stated") == F.col("body_sha1")), "left")
    out = lambda size, digest: ["page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "n_requests"]
    return rows.where("record_type <> 'revisit'").select(*out(F.col("own_bytes"), F.col("own_sha1"))).unionByName(again.select(*out(F.col("body_bytes"), F.col("body_sha1"))))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    return f"{shared_folder(spark)}/warc-{datetime.now(timezone.utc):%Y%m%d}-{uuid.uuid4().hex}"
