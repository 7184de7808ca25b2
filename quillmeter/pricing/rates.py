"""Rate tables: validation, payloads, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.schema import RATES

FIELDS = ["input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning"]

# USD per million tokens; a table of our own for tests and examples.
EXAMPLE = [
    ("claude-sonnet-4-5", "anthropic", 3.0, 15.0, 0.3, 3.75, 6.0, None, None, 200000, [(200000, 6.0, 22.5, 0.6, 7.5, 12.0)]),
    ("claude-opus-4-1", "anthropic", 15.0, 75.0, 1.5, 18.75, 30.0, None, None, 200000, None),
    ("gpt-5-codex", "openai", 1.25, 10.0, 0.125, None, None, None, None, 400000, None),
    ("gpt-5-mini", "openai", 0.25, 2.0, 0.025, 0.25, None, None, None, 400000, None),
    ("gemini-2.5-pro", "google", 1.25, 10.0, 0.31, 1.25, None, 10.0, "separate", 1048576, [(200000, 2.5, 15.0, 0.625, 2.5, None), (2000, 1.5, 11.0, 0.4, 1.5, None)]),
    ("gemini-2.5-flash", "google", 0.3, 2.5, 0.075, 0.3, None, 2.5, "separate", 1048576, None),
    ("moonshot/kimi-k2", "moonshot", 0.6, 2.5, 0.15, 0.6, None, None, None, 131072, None),
    ("openai/gpt-4o-2024-08-06", "openai", 2.5, 10.0, 1.25, None, None, None, None, 128000, None),
]


def example_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE, RATES)


def rates_from_payload(spark: SparkSession, path: str) -> DataFrame:
    """Rates of a JSON object {model: {input_cost_per_token, ...}}; keys for prompts above N thousand tokens become tiers.

    A rate that is listed at priority only holds in its place; priority_only says that one is.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("model_key", "r"))
    listed = lambda name: F.element_at("r", name).try_cast("double")
    per = lambda name: F.coalesce(listed(name), listed(name + "_priority")) * 1e6
    base = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost", "cache_write_1h": "cache_creation_input_token_cost_above_1hr", "reasoning": "output_cost_per_reasoning_token"}
    above = F.array_distinct(F.filter(F.transform(F.map_keys("r"), lambda k: F.regexp_extract(k, r"_above_([0-9]+)k_tokens$", 1).try_cast("bigint")), lambda x: x.isNotNull()))

    def tier(t):
        at = lambda name: (F.element_at("r", F.concat(F.lit(name), F.lit("_above_"), t.cast("string"), F.lit("k_tokens"))).try_cast("double") * 1e6)
        return F.struct((t * 1000).alias("above"), at(base["input"]).alias("input"), at(base["output"]).alias("output"), at(base["cache_read"]).alias("cache_read"), at(base["cache_write"]).alias("cache_write"), F.lit(None).cast("double").alias("cache_write_1h"))

    tiers = F.transform(F.reverse(F.array_sort(above)), tier)
    out = raw.select(F.lower("model_key").alias("model_key"), F.element_at("r", "litellm_provider").alias("provider"), *[per(v).alias(k) for k, v in base.items()], F.when(per(base["reasoning"]).isNotNull(), "separate").alias("reasoning_billing"), F.element_at("r", "max_input_tokens").try_cast("bigint").alias("max_input_tokens"), F.when(F.size(tiers) > 0, tiers).alias("tiers"), F.exists(F.array(*[F.coalesce(listed(v).isNull() & listed(v + "_priority").isNotNull(), F.lit(False)) for v in base.values()]), lambda x: x).alias("priority_only"))
    return valid_rates(out.where("input is not null or output is not null"))


def valid_rates(rates: DataFrame) -> DataFrame:
    """Rates that are all finite and at least 0; others are left out."""
    bad = F.lit(False)
    for f in FIELDS:
        bad = bad | (F.col(f).isNotNull() & (F.isnan(f) | (F.col(f) < 0) | (F.col(f) == float("inf"))))
    return rates.where(~bad)


def with_overrides(rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """rates with rows of overrides in place of, or beside, those of the same key."""
    return rates.join(overrides, "model_key", "left_anti").unionByName(overrides, allowMissingColumns=True).select(rates.columns)


def load_rates(*ways) -> tuple[DataFrame, str]:
    """(rates, name) of the first of ways, pairs of name and function, that gives any: a fresh copy, a fetch, a stale copy, a bundled one."""
    failed = []
    for name, way in ways:
        try:
            found = way()
            if found is not None and not found.isEmpty():
                return found, name
            failed.append(f"{name}: no rates")
        except Exception as error:  # a source that can't be read gives way to the next
            failed.append(f"{name}: {str(error).splitlines()[0]}")
    raise ValueError("no source of rates: " + "; ".join(failed))
