"""Incremental reading of growing logs: what grew, where to go on, what a second read replaces.

A cursor is a row a file: parser, bytes read up to the last whole line, a digest of those bytes, the
number of rows they gave, and hashes of the ids that later lines may repeat. Files that only grew are
read on; any other change, or a cursor that doesn't fit, reads the file again from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]
CURSOR = "file string, parser string, offset bigint, prefix string, rows bigint, ids array<bigint>"


def pipe(df: DataFrame, *stages: Stage) -> DataFrame:
    """df through stages, each a function of frames; lazy, like any frame."""
    for stage in stages:
        df = df.transform(stage)
    return df


def files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, size, modified) of what lies below a path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def growth(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(file, state): new, same, grown (larger and later, nothing else), changed, or gone, of files against those stored(file, size, modified)."""
    s, f = stored.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified")), found.select("file", "size", "modified")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    grown = (F.col("size") > F.col("_size")) & (F.col("modified") >= F.col("_modified"))
    state = F.when(F.col("_size").isNull(), "new").when(F.col("size").isNull(), "gone").when(same, "same").when(grown, "grown").otherwise("changed")
    return f.join(s, "file", "full").select("file", state.alias("state"))


def prefix_digest(data: bytes, offset: int) -> str | None:
    """The digest of a file's first bytes; None if it has fewer."""
    return hashlib.sha256(data[:offset]).hexdigest() if 0 <= offset <= len(data) else None


def fits(parser: Column, cursor_parser: Column, digest: Column, prefix: Column) -> Column:
    """Whether a cursor is this parser's, and the file still begins with the bytes that it covers."""
    return F.coalesce((parser == cursor_parser) & (digest == prefix), F.lit(False))


def read_on(spark: SparkSession, path: str, cursors: DataFrame, parser: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, value, restarted, offset, prefix): whole lines behind each file's cursor, all of them where it doesn't fit.

    line goes on from the cursor's rows. A line that isn't finished yet is left for the next read;
    offset and prefix, the same in all rows of a file, are what the next cursor says. A file
    without new lines has one row with a null value.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")
    both = content.join(cursors.select("file", "parser", F.col("offset").alias("_offset"), F.col("prefix").alias("_prefix"), F.col("rows").alias("_rows")), "file", "left")
    both = both.select("file", "content", "parser", "_offset", "_prefix", "_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data, own, offset, prefix, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ok = own == parser and prefix is not None and prefix_digest(data, offset) == prefix
                start, first = (offset, rows) if ok else (0, 0)
                end = data.rfind(b"\n") + 1
                lines = data[start : max(start, end)].split(b"\n")[:-1] or [None]
                n = len(lines)
                texts = [None if x is None else x.decode("utf-8", "replace") for x in lines]
                end = max(start, end)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(texts, pa.string()), pa.array([not ok] * n), pa.array([end] * n, pa.int64()), pa.array([prefix_digest(data, end)] * n)], names=["file", "line", "value", "restarted", "offset", "prefix"])

    return both.mapInArrow(run, "file string, line bigint, value string, restarted boolean, offset bigint, prefix string")


def next_cursors(read: DataFrame, parser: str, id_of: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """The cursors after read_on: where each file's next read starts, and hashes of the ids seen so far."""
    ids = F.collect_set(F.xxhash64(id_of)) if id_of is not None else F.array().cast("array<bigint>")
    out = read.groupBy("file").agg(F.lit(parser).alias("parser"), F.first("offset").alias("offset"), F.first("prefix").alias("prefix"), (F.max(F.when(F.col("value").isNotNull(), F.col("line") + 1).otherwise(F.col("line")))).alias("rows"), F.bool_or("restarted").alias("_again"), ids.alias("_ids")) if id_of is not None else read.groupBy("file").agg(F.lit(parser).alias("parser"), F.first("offset").alias("offset"), F.first("prefix").alias("prefix"), F.max(F.when(F.col("value").isNotNull(), F.col("line") + 1).otherwise(F.col("line"))).alias("rows"), F.bool_or("restarted").alias("_again")).withColumn("_ids", ids)
    if before is None:
        return out.select("file", "parser", "offset", "prefix", "rows", F.col("_ids").alias("ids"))
    earlier = before.select("file", F.col("ids").alias("_earlier"))
    kept = F.when(F.col("_again") | F.col("_earlier").isNull(), F.col("_ids")).otherwise(F.array_union("_earlier", "_ids"))
    return out.join(earlier, "file", "left").select("file", "parser", "offset", "prefix", "rows", kept.alias("ids"))


def conflicts(read: DataFrame, cursors: DataFrame, id_of: Column) -> DataFrame:
    """(file) files whose new lines repeat an id that earlier lines had, as its hash tells: their last rows may change, so they restart."""
    fresh = read.where(~F.col("restarted") & F.col("value").isNotNull()).select("file", F.xxhash64(id_of).alias("_id"))
    held = cursors.select("file", F.explode("ids").alias("_id"))
    return fresh.join(held, ["file", "_id"], "left_semi").select("file").distinct()


def join_resumed(stored: DataFrame, fresh: DataFrame, replaced: DataFrame) -> DataFrame:
    """stored rows and those read since; replaced(file, rows) says how many of a file's last stored rows the new ones replace.

    Files that were read from their start, with null rows, lose all that was stored.
    """
    last = stored.groupBy("file").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("file").orderBy("event_index"))
    kept = stored.withColumn("_i", nth).join(last, "file").join(replaced.select("file", F.col("rows").alias("_r"), F.lit(True).alias("_hit")), "file", "left")
    cut = F.when(F.col("_hit") & F.col("_r").isNull(), F.lit(False)).otherwise(F.col("_i") <= F.col("_n") - F.coalesce("_r", F.lit(0)))
    return kept.where(cut).select(*stored.columns).unionByName(fresh.select(*stored.columns))


def append_rows(stored: DataFrame, fresh: DataFrame, expected: DataFrame, current: DataFrame) -> DataFrame:
    """fresh rows of files whose stored cursor is still the one that the read began with; others were stored by another run meanwhile.

    expected and current are cursors. Rows are numbered on from the last stored one.
    """
    same = expected.select("file", F.col("offset").alias("_o"), F.col("prefix").alias("_p"))
    now = current.select("file", "offset", "prefix")
    ok = now.join(same, "file").where(F.col("offset").eqNullSafe(F.col("_o")) & F.col("prefix").eqNullSafe(F.col("_p"))).select("file")
    new = fresh.join(current.select("file"), "file", "left_anti").select("file").distinct()
    last = stored.groupBy("file").agg((F.max("event_index") + 1).alias("_next"))
    from pyspark.sql import Window

    rows = fresh.join(ok.unionByName(new), "file", "left_semi").join(last, "file", "left")
    n = F.row_number().over(Window.partitionBy("file").orderBy("event_index")) - 1
    return rows.withColumn("event_index", (F.coalesce("_next", F.lit(0)) + n).cast("bigint")).select(*fresh.columns)


def collect_files(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame], most: int = 100_000) -> tuple[dict[str, list], dict[str, str]]:
    """(rows, failures) by file: a file that fails gives nothing, and the others stay. For the few files of a tool, `most` rows each at most."""
    found: dict[str, list] = {}
    failed: dict[str, str] = {}
    for path in paths:
        try:
            rows = read(spark, path).limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} rows")
            found[path] = rows
        except Exception as error:  # whatever a file's reading raises is that file's own
            failed[path] = str(error).splitlines()[0]
    return found, failed


def read_events(spark: SparkSession, path: str, readers: dict[str, Callable[[SparkSession, str], DataFrame]], kinds: list[str] | None = None) -> DataFrame:
    """Events of the kinds wanted, from a reader a kind; a source that has no reader for any of them has no events of it."""
    wanted = [k for k in (kinds or ["usage"]) if k in readers]
    if not wanted:
        raise ValueError(f"the source reads {', '.join(readers)} only")
    out = readers[wanted[0]](spark, path)
    for k in wanted[1:]:
        out = out.unionByName(readers[k](spark, path), allowMissingColumns=True)
    return out
