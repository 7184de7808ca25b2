"""Windows of dates that reports are asked for: trailing periods, comparisons, calendars. All dates are YYYY-MM-DD."""

from __future__ import annotations

import calendar
import os
import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions.calendar import epoch_ms, iso_week, local


def shift(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days)).isoformat()


def month_end(day: str) -> str:
    y, m = int(day[:4]), int(day[5:7])
    return f"{day[:8]}{calendar.monthrange(y, m)[1]:02d}"


def periods_since(unit: str, today: str, count: int) -> str:
    """The first day of the `count` hours' days, days, weeks (from Monday) or months that end with today's."""
    if unit in ("hour", "day"):
        return shift(today, 1 - count)
    if unit == "week":
        return shift(today, -date.fromisoformat(today).weekday() - 7 * (count - 1))
    if unit != "month":
        raise ValueError(unit)
    index = int(today[:4]) * 12 + int(today[5:7]) - count
    return f"{index // 12:04d}-{index % 12 + 1:02d}-01"


def last_option(text: str | int | None, most: int = 100_000) -> int | None:
    """The number of periods that an option names, a whole number from 1 on."""
    if text is None:
        return None
    word = str(text).strip()
    if not re.fullmatch(r"[1-9]\d*", word) or int(word) > most:
        raise ValueError(f"not a whole number from 1 to {most}: {text}")
    return int(word)


def report_window(unit: str, today: str, since: str | None = None, until: str | None = None, last: int | str | None = None, everything: bool = False, default: int = 30) -> tuple[str | None, str | None]:
    """(since, until) of a report: what is given, the last periods, all, or `default` days without any of them."""
    n = last_option(last)
    if sum((n is not None, everything, bool(since or until))) > 1:
        raise ValueError("a window is given by dates, by a number of periods, or is everything")
    if since and until and since > until:
        raise ValueError("a window ends before it begins")
    if n is not None:
        return periods_since(unit, today, n), today
    if everything or since or until:
        return since, until
    return periods_since("day", today, default), today


def compare_windows(today: str, since: str | None = None, until: str | None = None, before_since: str | None = None, before_until: str | None = None) -> tuple[tuple[str, str], tuple[str, str]]:
    """(now, before): the month to date against the same days of the month before, or the window given against as many days before it."""
    for a, b in ((since, until), (before_since, before_until)):
        if (a is None) != (b is None):
            raise ValueError("a window needs both of its dates")
        if a and b and a > b:
            raise ValueError("a window ends before it begins")
    now = (since, until) if since else (f"{today[:8]}01", today)
    if before_since:
        return now, (before_since, before_until)
    if since:
        days = (date.fromisoformat(until) - date.fromisoformat(since)).days + 1
        return now, (shift(since, -days), shift(since, -1))
    last = shift(now[0], -1)
    return now, (f"{last[:8]}01", min(last, f"{last[:8]}{today[8:]}"))


def activity_start(today: str, weeks: int = 53) -> str:
    """The Monday that a grid of `weeks` weeks up to today's begins with."""
    return shift(today, -date.fromisoformat(today).weekday() - 7 * (weeks - 1))


def trend_range(today: str, observed_first: str | None, since: str | None = None, until: str | None = None, last: int | str | None = None, everything: bool = False) -> tuple[str, str]:
    """The dates that a trend shows: an open start is the first day observed, an open end today."""
    a, b = report_window("day", today, since, until, last, everything)
    end = b or (max(a, today) if a else today)
    return a or observed_first or end, end


def git_window(since: str | None, until: str | None) -> tuple[str | None, str | None]:
    """Instants between which commits of local dates lie in any zone: a day more on either side."""
    return since and f"{shift(since, -1)}T00:00:00Z", until and f"{shift(until, 1)}T23:59:59Z"


def value_window(today: str, since: str | None, until: str | None, first_month: str | None) -> tuple[str | None, str]:
    """The dates that plans are valued over: from the first month used where nothing is given, never past today."""
    return since or (f"{first_month}-01" if first_month else None), min(until or today, today)


def repo_value(value: str, cwd: str = "/", home: str = "/") -> tuple[str, str]:
    """('path', key) for a relative, home or absolute path; ('suffix', folders) for a project's last folders."""
    plain = value.strip().replace("\\", "/")
    if not plain:
        raise ValueError("a project can't be blank")
    if re.match(r"\.{1,2}(/|$)", plain):
        return "path", os.path.normpath(os.path.join(cwd, plain))
    if re.match(r"~(/|$)", plain):
        return "path", os.path.normpath(os.path.join(home, plain[2:]))
    if plain.startswith("/") or re.match(r"[A-Za-z]:/", plain):
        return "path", plain.rstrip("/") or "/"
    return "suffix", plain.strip("/")


def utc_offset(ts: Column, tz: str) -> Column:
    """Milliseconds that the zone's clock is ahead of UTC at an instant."""
    return epoch_ms(local(ts, tz)) - epoch_ms(ts)


def period_range(spark: SparkSession, since: str, until: str, unit: str = "day") -> DataFrame:
    """(period) every key between two dates, those without data too; 24 hours a day, also where a clock changes."""
    step = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[unit]
    first, last = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    if unit in ("week", "month"):
        first = F.date_trunc(unit, first).cast("timestamp_ntz")
    if unit == "hour":
        last = last + F.expr("interval 23 hours")
    at = spark.range(1).where(F.lit(since) <= F.lit(until)).select(F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("at"))
    key = iso_week(F.col("at").cast("date")) if unit == "week" else F.date_format("at", {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])
    return at.select(key.alias("period"))
