"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A number from text or number, null where it isn't finite."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def non_negative_int(c: Column) -> Column:
    """A count: text or number, cut to an integer, at least 0, 0 where it is none."""
    return F.coalesce(F.greatest(F.lit(0), F.floor(finite(c))), F.lit(0)).cast("bigint")


def usd(c: Column) -> Column:
    """A cost: at least 0, null where it is no finite number."""
    n = finite(c)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), n))


def money_sum(c: Column) -> Column:
    """A sum of costs that does not depend on the order; null where no cost is known."""
    return F.sum(c.cast("decimal(38,12)")).cast("double")


def delta_ratio(now: Column, before: Column) -> Column:
    """The change as a share of before: 0 for 0 after 0, null for anything else after 0."""
    return F.when(before == 0, F.when(now == 0, 0.0)).otherwise((now - before) / before)


def ratio(top: Column, bottom: Column, digits: int = 6) -> Column:
    return F.when(bottom != 0, F.round(top / bottom, digits))


def median(values: Column) -> Column:
    """The middle of an array of numbers, the mean of the two in the middle for an even count; null for none."""
    v = F.array_sort(values)
    n = F.size(v)
    at = lambda i: F.try_element_at(v, i.cast("int"))
    return F.when(n % 2 == 1, at(F.floor(n / 2) + 1)).otherwise((at(F.floor(n / 2)) + at(F.floor(n / 2) + 1)) / 2)


def cache_hit_rate() -> Column:
    """Cache reads over all tokens of prompts; null without any."""
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return F.when(prompt > 0, F.col("cache_read_tokens") / prompt)


def cost_per_hour(cost: Column, ms: Column) -> Column:
    """Cost over hours; null without time or cost."""
    return F.when(ms > 0, cost / (ms / F.lit(3_600_000.0)))


def whole(c: Column) -> Column:
    """A whole number of at least 0, null for anything else: no rounding, no sign, no fraction."""
    n = finite(c)
    return F.when((n >= 0) & (n == F.floor(n)) & (n <= 9007199254740991), n.cast("bigint"))
