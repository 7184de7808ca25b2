"""Text for people: numbers, money, durations, lines of a terminal, suggestions."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmeter.functions.text import without_control

ESCAPES = re.compile(r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])")
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f؜‎‏ -‮⁦-⁩]")


def terminal_line(text: str) -> str:
    """Text from elsewhere as one line that is safe to print."""
    return CONTROL.sub("", re.sub(r"\s+", " ", ESCAPES.sub("", text))).strip()


def terminal_column(c: Column) -> Column:
    """The same of a column, without escape sequences of the common form."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\x1B\[[0-9;?]*[ -/]*[@-~]", ""), r"\s+", " ")
    return F.trim(without_control(plain))


def width_of(text: str) -> int:
    """Columns that a text takes: wide letters two, marks that combine none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def truncate_middle(text: str, width: int) -> str:
    """A text in `width` columns, its middle as an ellipsis, so that start and end stay readable."""
    if width_of(text) <= width:
        return text
    if width <= 1:
        return "…"[: max(0, width)]

    def taken(letters: str, room: int) -> int:
        at = 0
        while at < len(letters) and width_of(letters[: at + 1]) <= room:
            at += 1
        return at

    head = math.ceil((width - 1) / 2)
    first, last = taken(text, head), taken(text[::-1], width - 1 - head)
    return text[:first] + "…" + (text[-last:] if last else "")


def integer(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def usd(c: Column) -> Column:
    """Dollars with two digits, - for none."""
    amount = F.format_number(F.abs(c), 2)
    return F.when(c.isNull(), "-").when((c < 0) & (amount != "0.00"), F.concat(F.lit("-$"), amount)).otherwise(F.concat(F.lit("$"), amount))


def percent(share: Column) -> Column:
    """A share of one with one digit, - for none."""
    return F.when(share.isNull(), "-").otherwise(F.format_string("%.1f%%", share * 100))


def compact(n: Column) -> Column:
    """1234 as 1.2k, 3400000 as 3.4M: one digit at most, none where it is 0."""
    scaled = lambda by, sign: F.concat(F.regexp_replace(F.format_string("%.1f", n / F.lit(by)), r"\.0$", ""), F.lit(sign))
    return F.when(n >= 1e9, scaled(1e9, "B")).when(n >= 1e6, scaled(1e6, "M")).when(n >= 1e3, scaled(1e3, "k")).otherwise(n.cast("string"))


def abbreviated(n: Column) -> Column:
    """Three significant digits: 1094000 as 1.09M, 24300 as 24.3K."""
    value = n.cast("double")

    def scaled(by: float, sign: str) -> Column:
        x = value / F.lit(by)
        digits = F.when(x < 9.995, F.round(x, 2)).when(x < 99.95, F.round(x, 1)).otherwise(F.round(x, 0))
        text = F.regexp_replace(F.format_string("%.2f", digits), r"\.?0+$", "")
        return F.concat(F.when(digits >= 10, F.regexp_replace(F.format_string("%.1f", digits), r"\.0$", "")).otherwise(text), F.lit(sign))

    out = F.when(value >= 999_500_000_000.0, scaled(1e12, "T")).when(value >= 999_500_000.0, scaled(1e9, "B")).when(value >= 999_500.0, scaled(1e6, "M")).when(value >= 999.5, scaled(1e3, "K"))
    return F.coalesce(out.otherwise(F.format_string("%.0f", value)), F.lit("0"))


def duration(ms: Column) -> Column:
    """Milliseconds as 2h 5m, 3h, 7m, <1m, or - for none."""
    minutes = F.round(ms / 60_000).cast("bigint")
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    long = F.when(minutes % 60 == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest, F.lit("m")))
    return F.when(ms <= 0, "-").when(minutes < 1, "<1m").when(minutes < 60, F.concat(rest, F.lit("m"))).otherwise(long)


def edits(a: str, b: str) -> int:
    """Insertions, removals, changes and swaps of neighbours between two words."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def closest(word: str, candidates: list[str]) -> str | None:
    """The first candidate with the fewest edits, if these are a third of the word at most and 3; else none."""
    word = word.strip().lower()
    most = min(3, max(1, len(word) // 3))
    near = [(edits(word, c.lower()), i) for i, c in enumerate(candidates)]
    best = min((n for n in near if n[0] <= most), default=None)
    return None if best is None else candidates[best[1]]


def project_labels(keys: list[str | None]) -> dict[str | None, str]:
    """The shortest tails of paths that tell projects apart; no repository is (unattributed).

    A key that has no more folders to add and still meets another is written whole, with a number
    if even that is taken. Distinct projects are few: this is a step of the report, not of the data.
    """
    from quillmeter.functions.text import UNATTRIBUTED

    segments = {k: [p for p in re.split(r"[/\\]", re.sub("^[A-Za-z]:", "", k)) if p] for k in keys if k is not None}
    labels: dict[str | None, str] = {None: UNATTRIBUTED} if None in keys else {}
    taken, depth = {UNATTRIBUTED}, dict.fromkeys(segments, 1)
    while depth:
        groups: dict[str, list[str]] = {}
        for k, d in depth.items():
            groups.setdefault(k if d > len(segments[k]) else "/".join(segments[k][-d:]), []).append(k)
        spent = []
        for label, members in groups.items():
            if len(members) == 1 and label not in taken:
                labels[members[0]] = label
                taken.add(label)
                del depth[members[0]]
                continue
            for k in members:
                if depth[k] >= len(segments[k]):
                    spent.append(k)
                else:
                    depth[k] += 1
        for k in sorted(spent):
            base = f"./{k}" if k == UNATTRIBUTED else k
            label, n = base, 2
            while label in taken:
                label, n = f"{base} #{n}", n + 1
            labels[k] = label
            taken.add(label)
            del depth[k]
    return labels


def fnv1a(text: str) -> int:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units."""
    # fixed values: the offset and the prime of the 32-bit hash
    value = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        value = (value ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return value
