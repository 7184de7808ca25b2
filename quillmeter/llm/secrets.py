"""Secret scans: base patterns, and weak credentials that only count where complementary parts meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import prepare
from quillmeter.llm.spans import in_order, joined, matches

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Code points between the edges of parts that still belong together.
REACH = 200

# Fixed patterns of the base kinds; runs can't be entered midway, so repetition needs no way back.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# Parts that prove nothing alone: an identifier, an opaque value, and where they would be used.
WEAK_ID = r"""(?:[Cc]lient|[Aa]ccount|[Aa]ccess|[Uu]ser|[Tt]enant)[_-]?(?:[Kk]ey[_-]?)?(?:[Ii][Dd]|[Nn]ame)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{4,}+|\bA[KS]IA[A-Z0-9]{8,15}+(?![A-Z0-9])"""
WEAK_SECRET = r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"""
ENDPOINT = r"""\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|ssh|jdbc:[a-z]{2,20})://[^\s"'<>\\]++"""


def base_spans(text: Column) -> dict[str, Column]:
    """assign (value of 6 or more characters), access and hex spans of texts, each an array."""
    value = lambda s: F.regexp_extract(s["value"], r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    return {
        "assign": F.filter(matches(text, ASSIGN, "assign"), lambda s: F.char_length(value(s)) >= 6),
        "access": matches(text, ACCESS, "access"),
        "hex": matches(text, HEX, "hex"),
    }


def weak_secrets(text: Column) -> Column:
    """weak_secret spans of texts: whole runs of any length that hold a digit, a lower-case and an upper-case letter."""
    return F.filter(matches(text, WEAK_SECRET, "weak_secret"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))


def linked_parts(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, linked): weak identifiers, weak secrets and endpoints that complement each other.

    A scope is what lies within `reach` code points of a secret part. Identifier parts (weak ids
    and base access keys), secret parts (weak secrets and base hex values) and endpoints are
    intervals of a text; a bucketed interval join, on text and every bucket that an interval
    widened by `reach` meets, pairs them. A weak identifier or secret is reported if a secret or
    an identifier lies in reach; an endpoint only if both do so. Joins are semi-joins, so a
    part is one row, however many partners it has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # cheap tests come first: most texts hold no identifier at all
    some = docs.where(text.rlike(WEAK_ID) | text.rlike(ACCESS))
    parts = some.select(
        F.col(id_col).alias("id"),
        F.sha1(text.cast("binary")).alias("text_key"),
        F.concat(matches(text, WEAK_ID, "weak_id"), matches(text, ACCESS, "access")).alias("ids"),
        F.concat(weak_secrets(text), matches(text, HEX, "hex")).alias("secrets"),
        matches(text, ENDPOINT, "endpoint").alias("ends"),
    )
    parts = parts.where("size(ids) > 0 and size(secrets) > 0").dropDuplicates(["id", "text_key"])
    one = parts.select("id", "text_key", F.explode(F.concat("ids", "secrets", "ends")).alias("s")).select("id", "text_key", "s.*")
    role = F.when(F.col("kind").isin("weak_id", "access"), "i").when(F.col("kind").isin("weak_secret", "hex"), "s").otherwise("e")
    one = one.withColumn("role", role)
    # an access key that also looks like an opaque value is no partner of itself
    one = one.where(~((F.col("kind") == "weak_secret") & F.col("value").rlike("^A[KS]IA[A-Z0-9]+$")))
    wide = one.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach))))

    def side(role_: str) -> DataFrame:
        x = one.where(F.col("role") == role_).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach))))
        return x.select("id", "text_key", "bucket", F.col("start").alias("a"), F.col("end").alias("b"))

    def meets(left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = left.alias("l"), right.alias("r")  # noqa: E741
        on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.text_key") == F.col("r.text_key")) & (F.col("l.bucket") == F.col("r.bucket"))
        near = (F.col("l.start") <= F.col("r.b") + reach) & (F.col("r.a") <= F.col("l.end") + reach)
        apart = (F.col("l.end") <= F.col("r.a")) | (F.col("r.b") <= F.col("l.start"))
        return l.join(r, on & near & apart, "left_semi").select("l.*")

    plain = [c for c in one.columns]
    ids = meets(wide.where("kind = 'weak_id'"), side("s"))
    secrets = meets(wide.where("kind = 'weak_secret'"), side("i"))
    ends = meets(wide.where("role = 'e'"), side("s")).select(*plain).distinct()
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach))))
    ends = meets(ends, side("i"))
    every = ids.select(*plain).unionByName(secrets.select(*plain)).unionByName(ends.select(*plain)).distinct()
    span = F.struct("start", "end", "kind", "value")
    return every.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("linked"))


def secret_spans(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans: arrays of (start, end, kind, value) in order of start and kind.

    Base spans always stay; linked_parts adds spans. Null texts count as empty. Rows that repeat an
    id are told apart by their texts. Columns of docs named like new ones are replaced.
    """
    prepare(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    kept = docs.drop("base_spans", "spans", "_key", "_link_id", "_link_key", "_linked")
    scanned = kept.withColumns({"base_spans": in_order(F.concat(*base.values()), KINDS), "_key": F.sha1(text.cast("binary"))})
    links = linked_parts(docs, reach, id_col, text_col).select(F.col("id").alias("_link_id"), F.col("text_key").alias("_link_key"), F.col("linked").alias("_linked"))
    out = scanned.join(links, F.col(id_col).eqNullSafe(F.col("_link_id")) & (F.col("_key") == F.col("_link_key")), "left")
    spans = F.when(F.col("_linked").isNull(), F.col("base_spans")).otherwise(in_order(F.concat("base_spans", "_linked"), KINDS))
    return out.withColumn("spans", spans).drop("_key", "_link_id", "_link_key", "_linked")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
