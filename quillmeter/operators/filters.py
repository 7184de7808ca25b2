"""Filters of usage rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.calendar import in_local_window
from quillmeter.functions.ranges import shift
from quillmeter.functions.text import UNATTRIBUTED, billing_provider, project_key
from quillmeter.schema import LOCAL


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def local_window(df: DataFrame, since: str | None = None, until: str | None = None, tz: str = "UTC") -> DataFrame:
    """Rows on local dates since..until, both included; the bounds reach the scan."""
    return df.where(in_local_window(F.col("ts"), since, until, tz))


def instant_window(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows from the instant since on and before until."""
    if since:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return df.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")) if until else df


def provider(df: DataFrame, value: str) -> DataFrame:
    """Rows whose billing provider holds value, itself read as a billing provider; null never does."""
    return df.where(billing_provider(F.col("provider")).contains(billing_provider(F.lit(value))))


def model(df: DataFrame, values: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Rows of the models named: a value that is a model of `seen` (df's own by default) matches that one alone, another any model that holds it."""
    wanted = [v.strip().lower() for v in values]
    present = {r[0] for r in (df if seen is None else seen).where(F.col("model").isin(wanted)).select("model").distinct().collect()}
    return df.where(any_of([F.col("model") == v if v in present else F.col("model").contains(v) for v in wanted]))


def with_lookback(df: DataFrame, since: str, until: str, days: int, tz: str = "UTC", models: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the window, rows of the days before it), both by the rule for models that the window resolves."""
    window = local_window(df, since, until, tz)
    before = local_window(df, shift(since, -days), shift(since, -1), tz)
    return (model(window, models), model(before, models, window)) if models else (window, before)


def source(df: DataFrame, values: list[str], known: list[str] | None = None) -> DataFrame:
    """Rows of sources; where those that there are are given, an unknown one is an error."""
    return df.where(F.col("source").isin(_known(values, known, "source")))


def machine(df: DataFrame, values: list[str], known: list[str] | None = None) -> DataFrame:
    """Rows of machines, this one named local; where the configured ones are given, an unknown one is an error."""
    return df.where(F.coalesce("machine", F.lit(LOCAL)).isin(_known(values, [*known, LOCAL] if known is not None else None, "machine")))


def _known(values: list[str], known: list[str] | None, what: str) -> list[str]:
    from quillmeter.operators.notes import known_names

    return values if known is None else known_names(values, known, what)


def repo(df: DataFrame, value: str) -> DataFrame:
    """Projects at or below an absolute path, projects that end in a path's segments, or rows without one."""
    key = project_key(F.col("repo_root"))
    if value == UNATTRIBUTED:
        return df.where(key.isNull())
    plain = value.replace("\\", "/").rstrip("/") or "/"
    slashed = F.translate(key, "\\", "/")
    if plain.startswith("/") or plain[1:3] == ":/":
        return df.where((slashed == plain) | slashed.startswith(plain if plain == "/" else plain + "/"))
    return df.where((slashed == plain) | slashed.endswith("/" + plain))


def session(df: DataFrame, values: list[str]) -> DataFrame:
    """Sessions whose id holds one of the values, in either case."""
    return df.where(any_of([F.lower("session_id").contains(v.lower()) for v in values]))


def kinds(df: DataFrame, values: list[str]) -> DataFrame:
    return df.where(F.col("kind").isin(values))


def priceable() -> Column:
    """Whether a row has tokens that can be billed."""
    return any_of([F.col(c) > 0 for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")])


def unmatched_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values that no row's column holds."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    names = df.select(F.lower(column).alias("name")).where("name is not null").distinct()
    return wanted.join(names, F.col("name").contains(F.lower("value")), "left_anti")
