"""Near-duplicate vectors by a pivot-permutation index with inverted pivot lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import connected_components, cut, prepare

#: Vectors of one side that a verification task holds at most.
BLOCK = 1024


#: Bytes of pivots that every task holds at most.
PIVOT_BYTES = 64 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows whose squares would leave the range of doubles are scaled by a power of two before."""
    most = np.abs(x).max(1)
    odd = (most > 1e140) | (most < 1e-140)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def nearest_of(similar: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` greatest values of each row, the greatest first, equal ones by place."""
    if count < similar.shape[1]:
        some = np.sort(np.argpartition(-similar, count - 1, axis=1)[:, :count], axis=1)
    else:
        some = np.broadcast_to(np.arange(similar.shape[1]), similar.shape)
    order = np.argsort(-np.take_along_axis(similar, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """`count` vectors at most, those whose ids have the smallest hashes: the bounded sample the index is fitted on."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(count).select("v").collect()
    return unit(np.array([r["v"] for r in rows], np.float64))


def near_vectors(table: DataFrame, least: float = 0.95, nearest: int = 12, shared: int = 2, pivots: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) from all pairs with cosine >= least that the index finds.

    Equal vectors are one class from the start. Each class is described by its `nearest` nearest
    pivots in order; pivots are 4 times the square root of the number of classes, as far as
    PIVOT_BYTES go, so lists grow slower than the table. Every vector enters the inverted list of each of its
    pivots. Within a list, pairs with `shared` pivots in common, or whose nearest two pivots
    agree, are candidates, and their cosine in double precision decides. A pair is looked at in
    the list of its smallest common pivot only, so counts need no list of pairs. Where two common
    pivots are needed, a list of more than `nearest` blocks is split into lists of two pivots, in
    each of which a vector is once, so copies don't grow with the list; a pair is then looked at
    in that of its two smallest common pivots. Lists are cut into blocks and blocks meet in
    pairs: no task holds over 2 * BLOCK vectors, and nothing is left out. n_links counts other rows, copies included.

    Vectors that are null, empty, zero or hold a null or a value that isn't finite link with
    nothing: n_links 0, component_id their own id. Vectors of different lengths never link. A row
    without an id counts among the links of others, but gives no component its id; its own is that
    of its class, or null. An empty table gives no rows.
    """
    spark = prepare(table)
    t = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    t = t.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))))
    # classes of equal vectors, by a digest so that no wide key is sorted twice
    t = t.withColumn("class", F.when(good, F.sha2(F.to_json("v").cast("binary"), 256)))
    t = cut(t)
    classes = t.where("class is not null").groupBy("class").agg(F.min("id").alias("least_id"), F.count("*").alias("mult"), F.first("v").alias("v"))
    # classes get a number of their own: the smallest id, or below all ids where none has one
    classes = cut(classes.withColumn("rep", F.coalesce("least_id", -F.abs(F.xxhash64("class")) - 2)))
    own = t.join(classes.select("class", "rep", "mult"), "class", "left")
    outputs = []
    for width in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        outputs.append(_links(classes.where(F.size("v") == width), least, nearest, shared, pivots))
    if outputs:
        found = outputs[0]
        for more in outputs[1:]:
            found = found.unionByName(more)
    else:
        found = spark.createDataFrame([], "rep bigint, linked bigint, least bigint")
    found = cut(found)
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    # a component is named by the smallest real id of its classes
    named = classes.join(parts, classes.rep == parts.id, "left").select(classes.rep, F.coalesce("component", "rep").alias("part"), "least_id")
    names = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "part").select("rep", "component_id").join(counts, "rep", "left")
    out = own.join(named, "rep", "left")
    n_links = F.when(F.col("class").isNull(), F.lit(0)).otherwise(F.col("mult") - 1 + F.coalesce("linked", F.lit(0))).cast("long")
    out = out.select(F.col("id").alias(id_col), n_links.alias("n_links"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, least: float, nearest: int, shared: int, pivots: int | None) -> DataFrame:
    """(rep, linked, least): links of each class with others, in rows, by list; the smallest rep it is joined to there."""
    n = classes.count()
    width = classes.select(F.size("v")).first()[0]
    centres = choose_pivots(classes, min(max(16, PIVOT_BYTES // (8 * width)), pivots or max(16, int(4 * n**0.5))))
    nearest = min(nearest, len(centres))
    need = min(shared, nearest)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2))
            for at in range(0, len(x), 256):
                part = batch.slice(at, 256)
                order = nearest_of(x[at : at + 256] @ centres.T, nearest).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(list(order), pa.list_(pa.int32()))], names=["rep", "mult", "v", "near"])

    described = cut(classes.select("rep", "mult", "v").mapInArrow(describe, "rep bigint, mult bigint, v array<double>, near array<int>"))
    # a list is told by its pivot, a part of a long one by a second, greater pivot
    lists = described.select("rep", "mult", "v", "near", F.explode("near").alias("pivot"))
    long = lists.groupBy("pivot").agg(F.count("*").alias("_n")).where((F.col("_n") > nearest * BLOCK) & F.lit(need > 1)).select("pivot", F.lit(True).alias("_long"))
    lists = lists.join(F.broadcast(long), "pivot", "left")
    second = F.when(F.col("_long"), F.filter("near", lambda p: p > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    lists = lists.select("pivot", F.explode(second).alias("second"), "rep", "mult", "v", "near")
    sizes = lists.groupBy("pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = lists.join(sizes, ["pivot", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.select("pivot", "second", "rep", "mult", "v", "near", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "mult", "v", "near", "own")

    def verify(group: pa.Table) -> pa.Table:
        pivot, second, i, j = (group.column(c)[0].as_py() for c in ("pivot", "second", "i", "j"))
        rep, mult, own = (group.column(c).to_numpy() for c in ("rep", "mult", "own"))
        x = _unit(group.column("v").combine_chunks())
        near = np.array(group.column("near").to_pylist(), np.int32)
        ids, local = np.unique(near, return_inverse=True)
        has = np.zeros((len(rep), len(ids)), np.float32)
        has[np.arange(len(rep))[:, None], local.reshape(near.shape)] = 1
        before = has[:, (ids < max(pivot, second)) & (ids != pivot)]
        linked = np.zeros(len(rep), np.int64)
        joined = np.arange(len(rep))
        for a in range(0, len(rep), 256):
            rows = slice(a, a + 256)
            ok = (has[rows] @ has.T >= need) & (before[rows] @ before.T == 0)
            if i != j:
                ok &= own[rows, None] != own[None, :]
            ok[np.arange(len(joined[rows])), np.arange(a, a + len(joined[rows]))] = False
            p, q = np.nonzero(ok)
            for at in range(0, len(p), 200_000):
                u, v = p[at : at + 200_000] + a, q[at : at + 200_000]
                hit = np.einsum("ij,ij->i", x[u], x[v]) >= least
                u, v = u[hit], v[hit]
                np.add.at(linked, u, mult[v])
                for s, t in zip(*np.unique(np.stack([u, joined[v]]), axis=1), strict=True) if len(u) else ():
                    if joined[s] != joined[t]:
                        low, high = sorted((joined[s], joined[t]))
                        joined[joined == high] = low
        smallest = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(smallest, joined, rep)
        some = np.flatnonzero(linked)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "linked": pa.array(linked[some], pa.int64()), "least": pa.array(smallest[joined[some]], pa.int64())})

    return placed.groupBy("pivot", "second", "i", "j").applyInArrow(verify, "rep bigint, linked bigint, least bigint")
