"""Places of pattern matches in texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths that are summed in one go; sums of whole blocks come first.
STEP = 128


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """For an array of integers, the sum of those before each, in about n * STEP steps."""
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), add)

    def with_values(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda b: total(F.slice(v, b * STEP + 1, F.lit(STEP))))

        def with_blocks(sums: Column) -> Column:
            ahead = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
            return let(ahead, lambda base: F.transform(v, lambda _, i: F.element_at(base, (F.floor(i / STEP) + 1).cast("int")) + total(F.slice(v, (F.floor(i / STEP) * STEP + 1).cast("int"), i % STEP))))

        return let(blocks, with_blocks)

    return F.when(F.size(values) > 0, let(values, with_values)).otherwise(F.array().cast("array<bigint>"))


SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a Java pattern, leftmost and without overlap: start, end (code points, end exclusive), kind, value.

    The pattern must not match the empty string. Splitting at the same pattern gives the gaps, so
    places are sums of lengths; texts without a match are only scanned once.
    """
    empty = F.array().cast(SPAN)

    def place(values: Column) -> Column:
        def between(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
            starts = F.zip_with(sums_before(steps), F.slice(gaps, F.lit(1), F.size(values)), lambda at, gap: at + F.char_length(gap))
            return F.zip_with(starts, values, lambda s, v: F.struct(s.alias("start"), (s + F.char_length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value")))

        return let(F.split(text, pattern, -1), between)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(found, lambda v: F.when(F.size(v) > 0, place(v)).otherwise(empty)).cast(SPAN)).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """spans by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))).cast(SPAN)
