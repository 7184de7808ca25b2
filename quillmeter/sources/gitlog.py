"""Commits from the text of git log --shortstat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = "commit\t"


def commits(spark: SparkSession, path: str, author: str | None = None) -> DataFrame:
    """(hash, ts, author, added, deleted, files) from lines `commit<TAB>hash<TAB>ISO time<TAB>author` and the statistics below each."""
    from quillmeter.sources.raw import timestamp_of

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")
    head = F.col("value").startswith(MARK)
    nth = F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    number = lambda word: F.regexp_extract("value", rf"(\d+) {word}", 1).try_cast("bigint")
    part = lambda i: F.max(F.when(head, F.element_at(F.split("value", "\t"), i)))
    total = lambda w: F.coalesce(F.sum(F.when(~head, number(w))), F.lit(0)).cast("bigint")
    out = raw.withColumn("n", nth).where("n > 0").groupBy("file", "n").agg(part(2).alias("hash"), part(3).alias("_ts"), part(4).alias("author"), total("insertion").alias("added"), total("deletion").alias("deleted"), total("files? changed").alias("files"))
    out = out.select("hash", timestamp_of(F.col("_ts")).alias("ts"), "author", "added", "deleted", "files")
    return out.where(F.lower("author") == author.lower()) if author else out
