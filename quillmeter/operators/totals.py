"""Totals of usage rows, and the usage report's grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import period_key
from quillmeter.functions.numbers import money_sum
from quillmeter.functions.text import UNATTRIBUTED, project_key
from quillmeter.schema import LOCAL, TOKENS


def totals() -> list[Column]:
    """The aggregates of a group: token sums, known cost, and whether a row has none."""
    return [*(F.sum(c).alias(c) for c in TOKENS), money_sum(F.col("cost_usd")).alias("cost_usd"), F.coalesce(F.bool_or(F.col("cost_usd").isNull()), F.lit(False)).alias("cost_incomplete")]


def merged_totals() -> list[Column]:
    """The same over rows that are totals already."""
    return [*(F.sum(c).alias(c) for c in TOKENS), money_sum(F.col("cost_usd")).alias("cost_usd"), F.bool_or("cost_incomplete").alias("cost_incomplete")]


def cost_state() -> Column:
    """none, known, partial or unknown."""
    known = F.col("cost_usd").isNotNull()
    return F.when(known & F.col("cost_incomplete"), "partial").when(known, "known").when(F.col("cost_incomplete"), "unknown").otherwise("none")


def usage_report(usage: DataFrame, unit: str = "day", tz: str = "UTC", by_machine: bool = False, by_repo: bool = False) -> DataFrame:
    """Rows by period and source (machine, project), one for a period's whole if it has several, and the grand total.

    One pass over usage with grouping sets, so partial sums are made before the only shuffle.
    An empty input gives the grand total alone, with cost 0.
    """
    split = ["source", *(["machine"] if by_machine else []), *(["project"] if by_repo else [])]
    rows = usage.withColumn("period", period_key(F.col("ts"), unit, tz))
    if by_machine:
        rows = rows.withColumn("machine", F.coalesce("machine", F.lit(LOCAL)))
    if by_repo:
        rows = rows.withColumn("project", F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)))
    keys = ["period", *split]
    sets = rows.groupingSets([[F.col(k) for k in keys], [F.col("period")], []], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("level"), *totals())
    groups = F.sum((F.col("level") == 0).cast("int")).over(Window.partitionBy("period"))
    kind = F.when(F.col("level") == 0, "period_source").when(F.col("level") == (1 << len(keys)) - 1, "grand_total").otherwise("period_combined")
    out = sets.withColumn("row_type", kind).withColumn("_groups", groups).where("row_type <> 'period_combined' or _groups > 1")
    grand = F.col("row_type") == "grand_total"
    fixed = {c: F.when(grand, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in TOKENS}
    empty_cost = F.when(grand & F.col("cost_usd").isNull() & ~F.col("cost_incomplete"), 0.0).otherwise(F.col("cost_usd"))
    out = out.withColumns(fixed).withColumn("cost_usd", empty_cost)
    return out.select("row_type", *keys, *TOKENS, "cost_usd", "cost_incomplete")


def model_breakdown(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by group and model, ranked: tokens, cost (unknown last), input, then name."""
    sums = usage.where("model is not null").groupBy(*keys, "model").agg(*totals())
    order = [F.col("total_tokens").desc(), F.col("cost_usd").desc_nulls_last(), F.col("input_tokens").desc(), F.col("model")]
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def fold_other_projects(usage: DataFrame, unit: str, keep: int, tz: str = "UTC", ranked_by: str = "cost") -> DataFrame:
    """By period: the `keep` largest projects, the others as one row with their number.

    A period with keep + 1 projects or fewer keeps them all. If any project's cost is incomplete
    there, tokens rank instead of cost.
    """
    rows = usage.withColumn("period", period_key(F.col("ts"), unit, tz)).withColumn("project", F.coalesce(project_key(F.col("repo_root")), F.lit(UNATTRIBUTED)))
    sums = rows.groupBy("period", "project").agg(*totals())
    of = Window.partitionBy("period")
    sums = sums.withColumn("_n", F.count("*").over(of)).withColumn("_tokens", F.bool_or("cost_incomplete").over(of) | F.lit(ranked_by == "tokens"))
    value = F.when(F.col("_tokens"), F.col("total_tokens").cast("double")).otherwise(F.coalesce("cost_usd", F.lit(0.0)))
    sums = sums.withColumn("_rank", F.row_number().over(of.orderBy(value.desc(), F.col("total_tokens").desc(), "project")))
    other = (F.col("_n") > keep + 1) & (F.col("_rank") > keep)
    folded = sums.withColumn("project", F.when(~other, F.col("project"))).groupBy("period", "project").agg(*merged_totals(), F.count("*").alias("projects"))
    return folded.withColumn("other_projects", F.when(F.col("project").isNull(), F.col("projects"))).drop("projects")


def with_cost_share(df: DataFrame, digits: int = 6) -> DataFrame:
    whole = F.sum(F.col("cost_usd").cast("decimal(38,12)")).over(Window.partitionBy(F.lit(0))).cast("double")
    return df.withColumn("cost_share", F.when(whole > 0, F.round(F.col("cost_usd") / whole, digits)))


def top(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """The first `count` rows, all for 0."""
    sorted_rows = df.orderBy(*order)
    return sorted_rows if count == 0 else sorted_rows.limit(count)
