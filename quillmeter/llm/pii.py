"""Personal data: base patterns, and identifiers that bootstrapped contexts discover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import cut, prepare
from quillmeter.llm.spans import SPAN, in_order, joined, let, matches

KINDS = ("email", "ip", "card", "phone", "context")

# Fixed patterns of the base kinds. A start is never tried within a run it could have begun
# earlier in, and repetition never goes back, so long runs cost no more than their length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: What an unseen identifier looks like: 6 characters or more with a digit. It ends with its run's last
#: letter or digit; punctuation may follow. Runs are entered at their start, and repetition never goes back.
TOKEN = r"(?<![A-Za-z0-9._@+/-])(?=[A-Za-z._@+/-]*+[0-9])(?=[A-Za-z0-9._@+/-]{5}[._@+/-]*+[A-Za-z0-9])[A-Za-z0-9@+][A-Za-z0-9]*+(?:[._@+/-]++[A-Za-z0-9]++)*+"
#: Bytes of discovered spans that go to all executors at most.
BROADCAST_BYTES = 16 << 20
#: Code points to either side that contexts are taken from.
REACH = 60


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def total(xs: Column) -> Column:
        n = F.size(xs)
        weigh = F.transform(xs, lambda x, i: F.when((n - i) % 2 == 1, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
        return F.aggregate(weigh, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(F.transform(F.split(digits, "(?<=[0-9])(?=[0-9])"), lambda c: c.cast("int")), total)


def base_spans(text: Column) -> dict[str, Column]:
    """email, ip, card and phone spans of texts, each an array; matches that fail a test are dropped."""
    octets = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
    card = lambda s: F.char_length(_digits(s["value"])).between(14, 19) & luhn(_digits(s["value"]))
    return {
        "email": matches(text, EMAIL, "email"),
        "ip": F.filter(matches(text, IP, "ip"), lambda s: s["value"].rlike(octets)),
        "card": F.filter(matches(text, CARD, "card"), lambda s: F.when(F.char_length(s["value"]) < 14, False).otherwise(card(s))),
        "phone": F.filter(matches(text, PHONE, "phone"), lambda s: F.char_length(_digits(s["value"])).between(10, 15)),
    }


def _plain(words: Column) -> Column:
    """Words in lower case, digits as 0, one space between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"\s+", " ")


def contexts(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns of a place: the two words before it, the two after it, and one to either side with a gap between.

    A word is up to 25 characters without white space; where a side has too few, its patterns are
    left out. Patterns say where they stand: "a b _", "_ c d", "b _ c".
    """
    before = F.substring(text, F.greatest(F.lit(1), start - REACH + 1).cast("int"), F.least(F.lit(REACH), start).cast("int"))
    after = F.substring(text, (end + 1).cast("int"), F.lit(REACH))
    found = lambda side, pattern: F.regexp_extract(side, pattern, 1)
    left2, left1 = found(before, r"(?:^|\s)([^\s]{1,25}\s+[^\s]{1,25})\s*$"), found(before, r"(?:^|\s)([^\s]{1,25})\s*$")
    right2, right1 = found(after, r"^[^\sA-Za-z0-9]*\s+([^\s]{1,25}\s+[^\s]{1,25})(?=\s|$)"), found(after, r"^[^\sA-Za-z0-9]*\s+([^\s]{1,25})(?=\s|$)")
    made = [
        F.when(left2 != "", F.concat(_plain(left2), F.lit(" _"))),
        F.when(right2 != "", F.concat(F.lit("_ "), _plain(right2))),
        F.when((left1 != "") & (right1 != ""), F.concat(_plain(left1), F.lit(" _ "), _plain(right1))),
    ]
    return F.array_compact(F.array(*made))


def occurrences(scanned: DataFrame) -> DataFrame:
    """(id, text_key, start, end, value, seed, pattern): base spans and look-alike tokens, a row for each of their contexts.

    scanned has id, text_key, text and base (spans). A token that meets a base span is no candidate.
    """
    tokens = F.filter(matches(F.col("text"), TOKEN, "context"), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    rows = scanned.select("id", "text_key", "text", F.explode(F.concat("base", tokens)).alias("s"))
    rows = rows.select("id", "text_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), (F.col("s.kind") != "context").alias("seed"), contexts(F.col("text"), F.col("s.start"), F.col("s.end")).alias("patterns"))
    return rows.select("id", "text_key", "start", "end", "value", "seed", F.explode("patterns").alias("pattern"))


def bootstrap(found: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """(pattern, value) of the unseen identifiers that trusted patterns extract from occurrences.

    The graph has an edge for each pattern and value that occur together; contexts() says what
    patterns there are. Seeds have score 1 for
    good, other values 0 at first. Each round scores a pattern by its values' mean score, one more
    value of score 0 counted in, if `support` distinct values of positive score or more hold it
    up; then a value by the chance that not all of its patterns are wrong. Patterns that reach
    `trust` extract their values. Both steps are grouped sums over distinct edges, with
    partial sums before the shuffle; each round's scores are checkpointed.
    """
    edges = cut(found.select("pattern", "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    # patterns without a seed, and values without such a pattern, can't gain a score in any round
    scores = cut(edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")))
    patterns = None
    for _ in range(rounds):
        known = edges.join(scores, "value")
        held = known.groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), F.sum((F.col("score") > 0).cast("int")).alias("up"))
        patterns = cut(held.where(F.col("up") >= support).select("pattern", (F.col("sum") / (F.col("n") + 1)).alias("weight")))
        if patterns.isEmpty():
            break
        doubt = edges.join(patterns, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.lit(1.0) - F.least("weight", F.lit(0.999)))).alias("doubt"))
        fresh = doubt.select(F.col("value").alias("v"), F.when(F.col("seed"), 1.0).otherwise(F.lit(1.0) - F.exp("doubt")).alias("s"))
        scores = cut(scores.join(fresh, scores.value == fresh.v, "left").select("value", F.greatest("score", F.coalesce("s", F.lit(0.0))).alias("score")))
    good = patterns.where(F.col("weight") >= trust).select("pattern")
    return edges.where(~F.col("seed")).join(good, "pattern").join(scores.where(F.col("score") >= trust), "value").select("pattern", "value")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, end, kind, value) in order of start and kind.

    Base spans always stay; bootstrap adds spans of kind context. Null texts count as empty. Rows
    that repeat an id are told apart by their texts. Columns of docs named like new ones are
    replaced. An empty table gives no rows.
    """
    prepare(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.drop("base_spans", "spans", "_key", "_more_id", "_more_key", "_more")
    base = in_order(F.concat(*base_spans(text).values()), KINDS)
    scanned = kept.withColumns({"base_spans": base, "_key": F.sha1(text.cast("binary"))})
    narrow = scanned.select(F.col(id_col).alias("id"), F.col("_key").alias("text_key"), text.alias("text"), F.col("base_spans").alias("base"))
    # only texts with a digit or @ can hold a seed or a candidate
    found = cut(occurrences(narrow.where(F.col("text").rlike("[0-9@]"))))
    new = bootstrap(found, **how)
    span = F.struct("start", "end", F.lit("context").alias("kind"), "value")
    more = found.where(~F.col("seed")).join(new, ["pattern", "value"]).groupBy("id", "text_key").agg(F.collect_set(span).cast(SPAN).alias("_more"))
    more = cut(more.select(F.col("id").alias("_more_id"), F.col("text_key").alias("_more_key"), "_more"))
    # where little was discovered it goes to the texts; else both sides meet by key
    size = more.agg(F.sum(F.octet_length(F.to_json("_more")) + 100).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        more = F.broadcast(more)
    out = scanned.join(more, F.col(id_col).eqNullSafe(F.col("_more_id")) & (F.col("_key") == F.col("_more_key")), "left")
    spans = F.when(F.col("_more").isNull(), F.col("base_spans")).otherwise(in_order(F.concat("base_spans", "_more"), KINDS))
    return out.withColumn("spans", spans).drop("_key", "_more_id", "_more_key", "_more")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, spans that meet as one, replaced by its first kind in angle brackets."""
    held = "array<struct<start:bigint,end:bigint,kind:string>>"

    def join_up(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        meets = (F.size(acc) > 0) & (s["start"] < last["end"])
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(held)

    merged = F.aggregate(spans, F.array().cast(held), join_up)

    def build(parts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(parts, lambda s: s["end"]))
        pieces = F.transform(parts, lambda s, i: F.concat(F.substring(text, (F.element_at(ends, i + 1) + 1).cast("int"), (s["start"] - F.element_at(ends, i + 1)).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        tail = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.when(F.size(spans) > 0, let(merged, build)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with personal data replaced in the text; a null text stays null, other columns as they are."""
    found = pii_spans(docs, text_col=text_col, **how)
    clean = F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), F.col("spans")))
    return found.withColumn(text_col, clean).drop("base_spans", "spans")


def pii_digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = pii_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
