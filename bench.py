"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter import catalogue
from quillmeter.operators import totals
from quillmeter.plans import bindings
from quillmeter.sources import logs, raw

HEADLINE = ["usage_daily", "usage_hourly", "usage_by_repo", "usage_at_scale", "usage_model_breakdown", "filter_local_window_tz", "price_both", "session_rows", "projects", "tools", "compare_metrics", "blocks_5h", "spend_spikes", "active_time_union_day", "dedupe_repeated_files", "dedupe_copied_sessions", "attribute_nearest_root", "machine_merge", "cube_cells", "content_hash"]


def write_logs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Session logs of one tool with a line an event of the tables, for the cold run."""
    u = bindings.usage(spark, sf_dir)
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"), F.col("cache_write_tokens").alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("m"), "event_index").alias("id"), F.coalesce("model", F.lit("claude-x")).alias("model"), usage.alias("usage"))
    line = F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.concat_ws("-", "source", "session_id").alias("sessionId"), F.col("repo_root").alias("cwd"), F.concat(F.lit("r"), "event_index").alias("requestId"), message.alias("message"))
    u.select(F.to_json(line).alias("value")).repartition(32).write.mode("overwrite").option("lineSep", "\n").text(path)
    # the reader takes files by their ending
    for name in os.listdir(path):
        if name.endswith(".txt"):
            os.rename(os.path.join(path, name), os.path.join(path, name[:-4] + ".jsonl"))


def cold(spark: SparkSession, path: str) -> DataFrame:
    """The daily report from log files, without a ledger."""
    return totals.usage_report(raw.good(logs.claude(spark, path)), "day")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["usage_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    with tempfile.TemporaryDirectory() as folder:
        write_logs(spark, sf_dir, os.path.join(folder, "logs"))
        began = time.time()
        cold(spark, os.path.join(folder, "logs")).write.format("noop").mode("overwrite").save()
        took["cold_ingest"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
