"""Notes that reports carry, and checks of what they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.text import billing_provider, provider_of_model
from quillmeter.operators.filters import priceable
from quillmeter.pricing.cost import with_rates


def reestimated_zero(usage: DataFrame, priced: DataFrame) -> DataFrame:
    """(source, events): rows logged at 0 with tokens that were estimated instead, by source.

    priced has the rows of usage, told by source, file and event_index, after pricing; null is a value of these.
    """
    keys = ["source", "file", "event_index"]
    zero = usage.where((F.col("cost_usd") == 0) & (F.col("total_tokens") > 0)).select(*keys)
    changed = priced.where("cost_mode = 'estimated'").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return zero.join(changed, same, "left_semi").groupBy("source").agg(F.count("*").alias("events"))


def priority_priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, events): estimated rows with tokens whose model is listed at priority rates only.

    rates has `priority_only`, true for such models.
    """
    rated = with_rates(usage.where(F.col("cost_mode") == "estimated"), rates)
    hit = F.coalesce(F.col("rates.priority_only"), F.lit(False)) & priceable()
    return rated.where(hit).groupBy("model").agg(F.count("*").alias("events"))


def usage_signal():
    """Whether a row says something about usage: tokens of any kind, or a cost."""
    return (F.col("total_tokens") > 0) | priceable() | F.col("cost_usd").isNotNull()


def repeated_hours(usage: DataFrame, tz: str) -> DataFrame:
    """(period): local hours that hold events of both of their occurrences, where the clock went back."""
    from quillmeter.functions.calendar import period_key
    from quillmeter.functions.ranges import utc_offset

    rows = usage.groupBy(period_key(F.col("ts"), "hour", tz).alias("period")).agg(F.min(utc_offset(F.col("ts"), tz)).alias("a"), F.max(utc_offset(F.col("ts"), tz)).alias("b"))
    return rows.where("a <> b").select("period")


def intersect_providers(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """Providers that both lists allow; none given allows all."""
    if a is None or b is None:
        return b if a is None else a
    return [p for p in a if p in set(b)]


def optimize_provider(usage: DataFrame, candidates: list[str], wanted: str | None = None) -> tuple[str, bool]:
    """(provider, inferred): the one that a comparison of models is about.

    Of several in usage, the only one that `wanted` or, without it, the candidates' owner names;
    anything else is refused. Providers are few, and only they leave the cluster.
    """
    name = F.coalesce(billing_provider(F.col("provider")), provider_of_model(F.col("model")))
    found = sorted(r[0] for r in usage.select(name.alias("p")).where("p is not null").distinct().limit(1000).collect())
    spark = usage.sparkSession
    ask = spark.createDataFrame([(c,) for c in candidates], "model string").select(provider_of_model(F.col("model")).alias("p")).distinct().collect()
    owners = [r["p"] for r in ask]
    word = wanted.strip().lower() if wanted else None
    if len(found) <= 1:
        return (found[0] if found else word or "unknown"), False
    if word:
        hits = [p for p in found if word in p]
        if len(hits) != 1:
            raise ValueError(f"{wanted} names {len(hits)} of the providers {', '.join(found)}")
        return hits[0], False
    if len(owners) == 1 and owners[0] in found and sum(owners[0] in p for p in found) == 1:
        return owners[0], True
    raise ValueError(f"usage has several providers: {', '.join(found)}")


def one_session(rows: DataFrame, ids: list[str], most: int = 10) -> DataFrame:
    """The only one of rows(source, session_id), or the only one whose id is one of ids; else an error that lists what there is."""
    wanted = [i.lower() for i in ids]
    exact = rows.where(F.lower("session_id").isin(wanted))
    some, hits = rows.limit(most + 1).collect(), exact.limit(2).collect()
    if len(some) == 1:
        return rows
    if len(hits) == 1:
        return exact
    named = ", ".join(f"{r['source']} {r['session_id']}" for r in some[:most])
    raise ValueError(f"no single session for {', '.join(ids)}: {named or 'none'}")


def need_prices(usage: DataFrame, policy: str = "both", show_cost: bool = True) -> bool:
    """Whether any row needs a rate under a policy, so that a table has to be loaded at all."""
    if not show_cost or policy == "explicit":
        return False
    ask = priceable() if policy == "estimated" else priceable() & (F.col("cost_usd").isNull() | (F.col("cost_usd") == 0))
    return not usage.where(ask).isEmpty()


def known_names(values: list[str], known: list[str], what: str) -> list[str]:
    """values, all of which have to be known; an unknown one is refused with the closest that is."""
    from quillmeter.functions.format import closest

    for v in values:
        if v not in known:
            near = closest(v, known)
            raise ValueError(f"unknown {what}: {v}" + (f"; did you mean {near}?" if near else ""))
    return values
