"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm.common import cut

#: Rows that one task ranks at most; larger groups of one source and size are split.
GROUP = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size): one row a source, with `target`.

    Sources in code-point order, null last, get the weights in turn. They share `share` times
    the sum of all sizes by weight; none gets over `most` times its size, and what that leaves
    over goes to the rest by weight. This is the level at which capped and uncapped shares add
    up: going through the sources by cap over weight, the first whose cap holds the remaining
    level fixes it for all later ones. A source without words has target 0. Only the table of
    sources, never that of documents, is put in one order here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.element_at(cycle, F.col("_i") % len(weights) + 1))
    s = s.withColumn("_cap", most * F.col("source_size"))
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    holds = F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct(F.row_number().over(ranked).alias("at"), F.col("_level").alias("level")))
    s = s.withColumn("_holds", holds).withColumn("_fixed", F.min("_holds").over(everything)["level"])
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_fixed")))
    return s.select("source", "source_size", target.alias("target"))


def systematic_sample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with source_size, target and `copies`, the number of times that the mix takes a row.

    A source's rows expect r = target / source_size copies each. In the order of size and id, the
    prefix sum of r, shifted by one offset per source, crosses an integer boundary `copies` times
    within a row. As neighbours have like sizes, the words taken stay within a few documents of
    the target. Ranks are counted by (source, size) first, groups over `GROUP` rows in salted
    parts, so that a hot source or size never lands in one task. The offset is a multiple of
    1/1024, from a digest of seed and source: reruns agree, and r = 2 gives 2 copies exactly.
    Rows with equal id and size may swap ranks; their number of copies in sum stays. A null id
    ranks like any other; a null size counts as 0; a null source is a source of its own.
    """
    docs = docs.withColumn("_s", F.coalesce(F.col(size_col), F.lit(0)))
    parts = docs.groupBy(source_col, "_s").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_parts", F.ceil(F.col("_n") / GROUP))
    kept = [c for c in docs.columns if c != "_s"]
    salted = docs.alias("d").join(parts.alias("p"), F.col(f"d.{source_col}").eqNullSafe(F.col(f"p.{source_col}")) & (F.col("d._s") == F.col("p._s")))
    salted = salted.select("d.*", F.pmod(F.xxhash64(F.col(f"d.{id_col}"), F.lit(7)), F.col("p._parts")).alias("_part"))
    key = [source_col, "_s", "_part"]
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(id_col)))
    counts = salted.groupBy(*key).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(source_col).orderBy("_s", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    same = F.col(f"r.{source_col}").eqNullSafe(F.col(f"c.{source_col}"))
    out = ranked.alias("r").join(counts.alias("c"), same & (F.col("r._s") == F.col("c._s")) & (F.col("r._part") == F.col("c._part")))
    out = out.join(targets.alias("t"), F.col(f"r.{source_col}").eqNullSafe(F.col("t.source")))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"r.{source_col}"), F.lit("\x00"))).cast("binary"))
    offset = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % 1024 / 1024.0
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(1.0))
    end = F.col("c._ahead") + F.col("r._k")
    copies = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return out.select(*[F.col(f"r.{c}") for c in kept], F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"), F.least(copies, F.ceil(rate)).alias("copies"))


def word_count(text_col: str):
    """The number of runs of characters other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """documents with size, source_size, target and copies; see source_targets and systematic_sample.

    Words are counted in one pass over the columns given, which is kept: select what is needed, or
    take mixed_rows, before the texts.
    """
    named = {"size", "source_size", "target", "copies"}
    kept = cut(docs.select(*[F.col(c) for c in docs.columns if c not in named and c != "text"], word_count("text").alias("size")))
    sizes = kept.groupBy("source").agg(F.sum("size").alias("source_size"))
    return systematic_sample(kept, source_targets(sizes, weights, share, most))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken.

    Copies are decided on rows without their texts, which travel once, to meet the decision. A
    row is told by a digest of its columns and, among equal rows, by a number: equal rows are each
    other's copies, so any of them may have any of their numbers.
    """
    plain = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    keyed = docs.withColumn("_key", plain)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    taken = mix_documents(keyed.select("doc_id", "source", "text", "_key"), **how).withColumn("_nth", nth).where("copies > 0").select("_key", "_nth", "copies")
    rows = keyed.withColumn("_nth", nth).join(taken, ["_key", "_nth"])
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
