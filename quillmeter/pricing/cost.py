"""Costs of usage rows under a rate table and a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.operators.filters import priceable
from quillmeter.pricing.rates import with_overrides
from quillmeter.pricing.resolve import resolve_models

POLICIES = ("both", "explicit", "estimated")


def prompt_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")


def with_rates(usage: DataFrame, rates: DataFrame, aliases: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """usage with a column `rates` (struct, null where the model has no key) and `model_key`.

    Names are resolved once each; the join on the name is an equi-join whose right side has one
    row a name, so AQE broadcasts it where it is small. overrides are rates of one's own: they
    hold for the names they are listed under, before any alias, and for the keys they name.
    """
    keys = resolve_models(usage, rates, aliases).where("model_key is not null").select("model", "model_key")
    table = rates
    if overrides is not None:
        raw = usage.select("model").where("model is not null").distinct().join(overrides.select("model_key"), F.lower("model") == F.lower("model_key"))
        keys = raw.unionByName(keys.join(raw.select("model"), "model", "left_anti"))
        table = with_overrides(rates, overrides)
    table = table.select(F.col("model_key"), F.struct(*[c for c in table.columns if c != "model_key"]).alias("rates"))
    return usage.join(keys.join(table, "model_key"), "model", "left")


def _field(base: str, tier: Column | None) -> Column:
    own = F.col(f"rates.{base}")
    return own if tier is None or base == "reasoning" else F.coalesce(tier[base], own)


def _tier(per_request: bool) -> Column | None:
    if not per_request:
        return None
    fits = F.try_element_at(F.filter("rates.tiers", lambda t: prompt_tokens() > t["above"]), F.lit(1))
    return F.when(F.col("single_request"), fits)


def _billed() -> tuple[Column, Column]:
    apart = F.coalesce(F.col("rates.reasoning_billing"), F.lit("included-in-output")) == "separate"
    return F.when(apart, F.greatest(F.lit(0), F.col("output_tokens") - F.col("reasoning_tokens"))).otherwise(F.col("output_tokens")), F.when(apart, F.col("reasoning_tokens")).otherwise(F.lit(0))


def estimated_cost(per_request: bool = True) -> Column:
    """The estimate of a row with `rates`; null where a used bucket has no rate or nothing can be billed."""
    tier = _tier(per_request)
    output, reasoning = _billed()
    write_1h = F.col("cache_write_1h_tokens")
    rate_write = _field("cache_write", tier)
    parts = [
        (F.col("input_tokens"), _field("input", tier)),
        (output, _field("output", tier)),
        (F.col("cache_read_tokens"), _field("cache_read", tier)),
        (F.col("cache_write_tokens") - write_1h, rate_write),
        (write_1h, F.coalesce(_field("cache_write_1h", tier), rate_write)),
        (reasoning, _field("reasoning", tier)),
    ]
    cost, missing = F.lit(0.0), F.lit(False)
    for tokens, rate in parts:
        cost = cost + F.coalesce(tokens / F.lit(1e6) * rate, F.lit(0.0))
    for tokens, rate in ((F.col("input_tokens"), _field("input", tier)), (output, _field("output", tier)), (F.col("cache_read_tokens"), _field("cache_read", tier)), (F.col("cache_write_tokens"), rate_write), (reasoning, _field("reasoning", tier))):
        missing = missing | ((tokens > 0) & rate.isNull())
    apart = F.coalesce(F.col("rates.reasoning_billing"), F.lit("included-in-output")) == "separate"
    some = (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0) | (F.col("cache_read_tokens") > 0) | (F.col("cache_write_tokens") > 0)
    only_hidden = (F.col("reasoning_tokens") > 0) & ~apart & (F.col("output_tokens") == 0)
    can = F.col("rates").isNotNull() & ~missing & ~only_hidden & (some | ((F.col("reasoning_tokens") > 0) & apart))
    return F.when(can, cost)


def outcome(policy: str) -> Column:
    """What a policy does to a row with its `_estimate`: unchanged, relabelled (estimated, the cost as it is), unpriced or priced.

    A cost that was logged as 0 beside tokens that can be billed, of a model that has a name, is
    asked for again where logged costs are kept; so is none at all.
    """
    logged = F.col("cost_usd").isNotNull()
    can = F.col("model").isNotNull() & priceable() & F.col("_estimate").isNotNull()
    if policy == "explicit":
        return F.when(logged, "unchanged").otherwise("unpriced")
    if policy == "estimated":
        return F.when(can, "priced").otherwise("unpriced")
    zero = logged & (F.col("cost_usd") == 0) & F.col("model").isNotNull() & priceable()
    return F.when(logged & ~zero, "unchanged").when(can, "priced").when(zero, "unchanged").otherwise("relabelled")


def priced(usage: DataFrame, rates: DataFrame, policy: str = "both", per_request: bool = True, aliases: DataFrame | None = None, overrides: DataFrame | None = None, with_outcome: bool = False) -> DataFrame:
    """usage with cost_usd and cost_mode under a policy, and `outcome` on wish.

    explicit keeps logged costs only; estimated ignores them; both keeps them, but estimates rows
    without one and rows with billable tokens that were logged at 0, which stay at 0 where no
    estimate is possible.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    if policy == "explicit":
        rated = usage.withColumn("_estimate", F.lit(None).cast("double"))
    else:
        rated = with_rates(usage, rates, aliases, overrides).withColumn("_estimate", estimated_cost(per_request))
    rated = rated.withColumn("_outcome", outcome(policy))
    done = F.col("_outcome")
    cost = F.when(done == "priced", F.col("_estimate")).when(done != "unpriced", F.col("cost_usd"))
    mode = F.when((done == "unchanged") & F.col("cost_usd").isNotNull(), "explicit").otherwise("estimated")
    kept = [c for c in usage.columns if c not in ("cost_usd", "cost_mode", "outcome")]
    out = rated.select(*kept, cost.alias("cost_usd"), mode.alias("cost_mode"), done.alias("outcome"))
    order = [*usage.columns, *([] if "cost_mode" in usage.columns else ["cost_mode"])]
    return out.select(*order, *(["outcome"] if with_outcome and "outcome" not in order else []))


def explain(names: DataFrame, rates: DataFrame, aliases: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(model, model_key, rule, override, edits, rates): how each of names(model) comes to its rates.

    override says whether rates of one's own apply to the name itself (raw) or to the key that it
    resolves to (resolved); edits are those of a fuzzy match.
    """
    from quillmeter.functions.text import fuzzy_form

    found = resolve_models(names, rates, aliases)
    out = found.withColumn("override", F.lit("none"))
    table = rates
    if overrides is not None:
        own = overrides.select(F.lower("model_key").alias("_own"), F.col("model_key").alias("_name"))
        hit = found.join(own, F.lower("model") == F.col("_own"), "left")
        hit = hit.join(own.select(F.col("_own").alias("_own2")), F.lower("model_key") == F.col("_own2"), "left")
        state = F.when(F.col("_own").isNotNull(), "raw").when(F.col("_own2").isNotNull(), "resolved").otherwise("none")
        out = hit.select("model", F.coalesce("_name", "model_key").alias("model_key"), F.when(F.col("_own").isNull(), F.col("rule")).alias("rule"), state.alias("override"))
        table = with_overrides(rates, overrides)
    edits = F.when(F.col("rule") == "fuzzy", F.levenshtein(fuzzy_form(F.element_at(F.split("model", "/"), -1)), fuzzy_form(F.col("model_key"))))
    rated = table.select("model_key", F.struct(*[c for c in table.columns if c != "model_key"]).alias("rates"))
    return out.withColumn("edits", edits).join(rated, "model_key", "left").select("model", "model_key", "rule", "override", "edits", "rates")


def long_context_extra(rated: DataFrame) -> DataFrame:
    """rated rows with `tier_extra`: the estimate at the tier's rates less that at base rates; 0 without a tier."""
    tier = _tier(True)
    return rated.withColumn("tier_extra", F.when(tier.isNull(), F.when(F.col("rates").isNotNull(), 0.0)).otherwise(estimated_cost(True) - estimated_cost(False)))


def cache_saving() -> Column:
    """What cache reads saved against the input rate, never below 0; null where a rate is missing or nothing was read."""
    gain = F.col("cache_read_tokens") / F.lit(1e6) * (F.col("rates.input") - F.col("rates.cache_read"))
    return F.when((F.col("cache_read_tokens") > 0) & gain.isNotNull(), F.greatest(F.lit(0.0), gain))
